"""The query language of the full-text search: words, phrases, prefixes, columns, first tokens, NEAR and operators.

`parse` turns a query into a tree; `matches` and `score` turn the tree into columns over a table with token arrays,
so a search is a projection and a filter that Spark plans like any other."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from darkslide.functions.text import fold_query

COLUMNS = ("path", "filename", "metadata_text")
NEAR_TOKENS = 10
# Constants of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class QuerySyntaxError(ValueError):
    """A query that isn't well formed."""


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


@dataclass(frozen=True)
class Without:
    left: Node
    right: Node


Node = Phrase | Near | Both | Either | Without


# Fixed value: what a query may hold; anything else becomes a blank.
NOT_ALLOWED = r'[^\w\s"*:^()]'


def sanitise(query: str) -> str:
    """Everything but words, blanks and the signs of the language becomes a blank; blanks are collapsed."""
    return re.sub(r"\s+", " ", re.sub(NOT_ALLOWED, " ", query)).strip()


def _lex(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c == '"':
            end = text.find('"', i + 1)
            while end >= 0 and text[end + 1 : end + 2] == '"':
                end = text.find('"', end + 2)
            if end < 0:
                raise QuerySyntaxError("unterminated string")
            out.append(("string", text[i + 1 : end].replace('""', '"')))
            i = end + 1
        elif c in "()*:^":
            out.append((c, c))
            i += 1
        else:
            end = i
            while end < len(text) and (text[end].isalnum() or text[end] == "_" or ord(text[end]) > 127):
                end += 1
            if end == i:
                raise QuerySyntaxError(f"unexpected {c!r}")
            word = text[i:end]
            out.append((word if word in ("AND", "OR", "NOT") else "word", word))
            i = end
    return out


class _Parser:
    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items, self.at = items, 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.items[i][0] if i < len(self.items) else "end"

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise QuerySyntaxError("unexpected end")
        self.at += 1
        return self.items[self.at - 1]

    def expect(self, kind: str) -> None:
        if self.peek() != kind:
            raise QuerySyntaxError(f"expected {kind!r}")
        self.take()

    def either(self) -> Node | None:
        node = self.both()
        while self.peek() == "OR":
            self.take()
            right = self.both()
            node = right if node is None else node if right is None else Either(node, right)
        return node

    def both(self) -> Node | None:
        node = self.without()
        while self.peek() == "AND":
            self.take()
            right = self.without()
            node = None if node is None or right is None else Both(node, right)
        return node

    def without(self) -> Node | None:
        node = self.unit(COLUMNS)
        while self.peek() == "NOT":
            self.take()
            right = self.unit(COLUMNS)
            node = node if node is None or right is None else Without(node, right)
        return node

    def scope(self) -> tuple[str, ...] | None:
        if self.peek() in ("word", "string") and self.peek(1) == ":":
            name = self.take()[1].lower()
            self.take()
            if name not in COLUMNS:
                raise QuerySyntaxError(f"no such column: {name}")
            return (name,)
        return None

    def unit(self, columns: tuple[str, ...]) -> Node | None:
        start = self.at
        scoped = self.scope()
        if self.peek() == "(":
            self.take()
            inner = self.either()
            self.expect(")")
            if self.peek() in ("word", "string", "(", "^"):
                raise QuerySyntaxError("a group can't stand next to another term")
            return _scoped(inner, scoped) if scoped and inner else inner
        self.at = start
        node: Node | None = None
        seen = False
        while self.peek() in ("word", "string", "^"):
            item = self.item(columns)
            seen = True
            node = item if node is None else node if item is None else Both(node, item)
        if not seen:
            raise QuerySyntaxError("a term is missing")
        if self.peek() == "(":
            raise QuerySyntaxError("a group can't stand next to another term")
        return node

    def item(self, columns: tuple[str, ...]) -> Node | None:
        scoped = self.scope()
        columns = scoped or columns
        if self.peek() == "(":
            raise QuerySyntaxError("a group can't stand next to another term")
        if self.peek() == "word" and self.items[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.take()
            self.take()
            phrases = []
            while self.peek() != ")":
                phrases.append(self.phrase(columns))
            self.take()
            if not phrases:
                raise QuerySyntaxError("NEAR without a phrase")
            phrases = [p for p in phrases if p.tokens]
            return (phrases[0] if len(phrases) == 1 else Near(tuple(phrases), columns)) if phrases else None
        made = self.phrase(columns)
        return made if made.tokens else None

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.take()
        kind, text = self.take()
        if kind not in ("word", "string"):
            raise QuerySyntaxError(f"unexpected {text!r}")
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(tuple(fold_query(text)), prefix, first, columns)


def _scoped(node: Node, columns: tuple[str, ...]) -> Node:
    if isinstance(node, Phrase):
        inner = tuple(c for c in node.columns if c in columns)
        return Phrase(node.tokens, node.prefix, node.first, inner)
    if isinstance(node, Near):
        inner = tuple(c for c in node.columns if c in columns)
        return Near(tuple(_scoped(p, columns) for p in node.phrases), inner)
    return type(node)(_scoped(node.left, columns), _scoped(node.right, columns))


def parse(query: str) -> Node | None:
    """The tree of a query, None if it can match nothing because it has no token. Blank queries aren't parsed: they
    put no condition on the text."""
    items = _lex(sanitise(query))
    if not items:
        raise QuerySyntaxError("the query is empty")
    parser = _Parser(items)
    node = parser.either()
    if parser.peek() != "end":
        raise QuerySyntaxError(f"unexpected {parser.take()[1]!r}")
    return node


def positions(tokens: Column, p: Phrase) -> Column:
    """Positions, from 0, at which a phrase starts in an array of tokens."""
    n = len(p.tokens)
    last = F.size(tokens) - n + 1

    def starts(i: Column) -> Column:
        ok = F.lit(True)
        for k, t in enumerate(p.tokens):
            token = F.get(tokens, i + k)
            ok = ok & (token.startswith(t) if p.prefix and k == n - 1 else token == t)
        return ok & (i == 0) if p.first else ok

    at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, starts)


def phrase_matches(p: Phrase, tokens: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in p.columns:
        if len(p.tokens) == 1 and not p.first:
            t = p.tokens[0]
            one = F.exists(tokens[c], lambda x: x.startswith(t)) if p.prefix else F.array_contains(tokens[c], t)
        else:
            one = F.size(positions(tokens[c], p)) > 0
        out = out | one
    return out


def within(others: list[Column], length: int) -> Callable[[Column], Column]:
    """For the start of a first phrase of some length: whether each of the others starts near enough after it."""

    def near(i: Column) -> Column:
        ok = F.lit(True)
        for other in others:
            ok = ok & F.exists(other, lambda j: (j >= i) & (j - (i + length) <= NEAR_TOKENS))
        return ok

    return near


def near_matches(n: Near, tokens: dict[str, Column]) -> Column:
    """All phrases in one column, with at most ten tokens between the end of the first and the start of the last."""
    out = F.lit(False)
    for c in n.columns:
        found = [positions(tokens[c], p) for p in n.phrases]
        for k, p in enumerate(n.phrases):
            others = found[:k] + found[k + 1 :]
            out = out | F.exists(found[k], within(others, len(p.tokens)))
    return out


def matches(node: Node | None, tokens: dict[str, Column]) -> Column:
    """Whether a row matches, given its arrays of tokens by column."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Phrase):
        return phrase_matches(node, tokens)
    if isinstance(node, Near):
        return near_matches(node, tokens)
    left, right = matches(node.left, tokens), matches(node.right, tokens)
    return left & right if isinstance(node, Both) else left | right if isinstance(node, Either) else left & ~right


def phrases(node: Node | None) -> list[Phrase]:
    """The phrases that can contribute to the score, repetitions too; what is excluded can't."""
    if node is None:
        return []
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return phrases(node.left) if isinstance(node, Without) else phrases(node.left) + phrases(node.right)


def plausible(node: Node | None, folded: dict[str, Column]) -> Column:
    """A cheap condition that every match meets: the folded texts hold the tokens somewhere. It decides which rows are
    worth cutting into tokens."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Phrase):
        out = F.lit(False)
        for c in node.columns:
            inside = F.lit(True)
            for t in node.tokens:
                inside = inside & folded[c].contains(t)
            out = out | inside
        return out
    if isinstance(node, Near):
        out = F.lit(True)
        for p in node.phrases:
            out = out & plausible(p, folded)
        return out
    left = plausible(node.left, folded)
    if isinstance(node, Without):
        return left
    right = plausible(node.right, folded)
    return left & right if isinstance(node, Both) else left | right


def frequency(p: Phrase, tokens: dict[str, Column]) -> Column:
    out = F.lit(0)
    for c in p.columns:
        if len(p.tokens) == 1 and not p.first:
            t = p.tokens[0]
            found = F.filter(tokens[c], (lambda x: x.startswith(t)) if p.prefix else (lambda x: x == t))
        else:
            found = positions(tokens[c], p)
        out = out + F.size(found)
    return out


def weight(documents: int, holding: int) -> float:
    """The weight of a phrase that so many of all documents hold."""
    value = math.log((documents - holding + 0.5) / (holding + 0.5))
    return value if value > 0 else LEAST_IDF


def bm25(tf: Column, length: Column, idf: float, average: float) -> Column:
    return -F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def score(node: Node | None, tokens: dict[str, Column], idf: dict[Phrase, float], average: float) -> Column:
    """The BM25 rank, negative and better the lower: a phrase counts only where every part of the tree around it
    matches."""
    if node is None:
        return F.lit(0.0)
    if isinstance(node, Phrase):
        tf = frequency(node, tokens).cast("double")
        length = F.lit(0)
        for c in COLUMNS:
            length = length + F.size(tokens[c])
        return bm25(tf, length, idf[node], average)
    if isinstance(node, Near):
        inner = sum((score(p, tokens, idf, average) for p in node.phrases[1:]),
                    score(node.phrases[0], tokens, idf, average))
    elif isinstance(node, Without):
        inner = score(node.left, tokens, idf, average)
    else:
        inner = score(node.left, tokens, idf, average) + score(node.right, tokens, idf, average)
    return F.when(matches(node, tokens), inner).otherwise(0.0)

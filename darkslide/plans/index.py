"""The inverted index: postings and statistics that are stored with the catalogue, and searches that read only the postings
of their terms."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.text import token_count, tokens
from darkslide.plans import match
from darkslide.sources.tables import spread, union, written

TABLES = ("postings", "lengths", "totals")


def postings(index: DataFrame) -> DataFrame:
    """(term, id, col, pos): one row per token."""
    index = spread(index, "id")
    parts = [
        index.select("id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term"))
        for c in match.COLUMNS
    ]
    return union(*parts).select("term", "id", "col", "pos")


def ranged(made: DataFrame) -> DataFrame:
    """Postings ranged by term and sorted, so that a term's rows lie in few row groups and the statistics of the others
    exclude them. A term that fills many files is spread over them by id."""
    return made.repartitionByRange("term", "id").sortWithinPartitions("term", "id", "col", "pos")


@dataclass
class Stored:
    """A stored index: postings as `ranged` leaves them, (id, length) of every document, and one row of totals
    (documents, average)."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame

    def matching(self, node: match.Node | None) -> DataFrame:
        """(id) of the documents that match."""
        return self._places(node).where(matches(node)).select("id")

    def scored(self, node: match.Node | None) -> DataFrame:
        """(id, score) of the documents that match. How many documents hold each phrase is counted over the postings of
        the query's terms; the number of documents and their average length are stored."""
        places = self._places(node)
        found = sorted(set(match.phrases(node)), key=repr)
        total = self.totals.first()
        n, average = (total["documents"], total["average"] or 1.0) if total else (0, 1.0)
        weights: dict[match.Phrase, float] = {}
        if found:
            counts = places.agg(*[F.count_if(matches(p)) for p in found]).first()
            weights = {p: match.weight(n, df) for p, df in zip(found, counts, strict=True)}
        kept = places.where(matches(node)).join(self.lengths, "id")
        return kept.select("id", score(node, weights, average).alias("score"))

    def _places(self, node: match.Node | None) -> DataFrame:
        """(id, an array of positions for each token and column of the query): one exchange of the postings of the query's
        tokens, which is all that is read."""
        wanted, columns = F.lit(False), []
        for token, prefix in sorted(_tokens(node)):
            is_token = F.col("term").startswith(token) if prefix else F.col("term") == token
            wanted = wanted | is_token
            for c in match.COLUMNS:
                at = F.collect_list(F.when(is_token & (F.col("col") == c), F.col("pos")))
                columns.append(at.alias(_name(token, prefix, c)))
        rows = self.postings.where(wanted)
        return rows.groupBy("id").agg(*columns) if columns else rows.select("id")


def build(index: DataFrame) -> Stored:
    """The tables of a stored index, as plans."""
    length = F.lit(0)
    for c in match.COLUMNS:
        length = length + token_count(F.col(c))
    lengths = index.select("id", length.cast("bigint").alias("length"))
    totals = lengths.agg(F.count("*").alias("documents"), F.avg("length").alias("average"))
    return Stored(ranged(postings(index)), lengths, totals)


def store(index: DataFrame) -> Stored:
    """An index stored in the shared folder."""
    made = build(index)
    return Stored(*[written(getattr(made, t), t) for t in TABLES])


def write_postings(index: DataFrame, path: str) -> None:
    ranged(postings(index)).write.mode("overwrite").parquet(path)


_open: dict[tuple[str, str], Stored] = {}


def stored(spark: SparkSession, name: str, index: Callable[[], DataFrame]) -> Stored:
    """The index called `name`, built when the session first asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _open:
        _open[key] = store(index())
    return _open[key]


def _tokens(node: match.Node | None) -> set[tuple[str, bool]]:
    """The tokens of a query, each with whether only its beginning is given."""
    if node is None:
        return set()
    if isinstance(node, match.Phrase):
        last = len(node.tokens) - 1
        return {(t, node.prefix and k == last) for k, t in enumerate(node.tokens)}
    parts = node.phrases if isinstance(node, match.Near) else (node.left, node.right)
    return set().union(*map(_tokens, parts))


def _name(token: str, prefix: bool, column: str) -> str:
    return f"{column}.{token}" + ("*" if prefix else "")


def _starts(p: match.Phrase, column: str) -> Column:
    """Where a phrase starts in a column."""
    last = len(p.tokens) - 1
    at = [F.col(f"`{_name(t, p.prefix and k == last, column)}`") for k, t in enumerate(p.tokens)]

    def follows(i: Column) -> Column:
        ok = i == 0 if p.first else F.lit(True)
        for k in range(1, len(at)):
            ok = ok & F.array_contains(at[k], i + k)
        return ok

    return F.filter(at[0], follows) if p.first or len(at) > 1 else at[0]


def matches(node: match.Node | None) -> Column:
    """Whether a document matches, given its positions."""
    if node is None:
        return F.lit(False)
    out = F.lit(False)
    if isinstance(node, match.Phrase):
        for c in node.columns:
            out = out | (F.size(_starts(node, c)) > 0)
        return out
    if isinstance(node, match.Near):
        for c in node.columns:
            found = [_starts(p, c) for p in node.phrases]
            for k, p in enumerate(node.phrases):
                out = out | F.exists(found[k], match.within(found[:k] + found[k + 1 :], len(p.tokens)))
        return out
    left, right = matches(node.left), matches(node.right)
    if isinstance(node, match.Both):
        return left & right
    return left | right if isinstance(node, match.Either) else left & ~right


def score(node: match.Node | None, weights: dict[match.Phrase, float], average: float) -> Column:
    """The rank of a document with its positions and length."""
    if node is None:
        return F.lit(0.0)
    if isinstance(node, match.Phrase):
        tf = F.lit(0)
        for c in node.columns:
            tf = tf + F.size(_starts(node, c))
        return match.bm25(tf.cast("double"), F.col("length"), weights[node], average)
    if isinstance(node, match.Near):
        parts = list(node.phrases)
    else:
        parts = [node.left] if isinstance(node, match.Without) else [node.left, node.right]
    inner = score(parts[0], weights, average)
    for part in parts[1:]:
        inner = inner + score(part, weights, average)
    return F.when(matches(node), inner).otherwise(0.0)

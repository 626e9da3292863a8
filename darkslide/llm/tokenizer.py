"""Exact byte-pair encoding of a whole corpus with a public tokenizer.

For every prefix of a piece of text there is exactly one last token that its encoding can end in. A token that is a
suffix of the prefix is that one if it starts the piece, or if the last token of what comes before and it are a
compatible pair: encoded together, they stay these two tokens. So one scan with the suffix automaton of the vocabulary,
a table of last tokens and the way back through it give the same ids as merging pairs by rank, in linear time."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
# Fixed value: how the tokenizer cuts text into pieces that are encoded alone.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000  # pieces and pairs that a worker remembers before it starts anew
LONGEST_REMEMBERED = 64


def _byte_signs() -> list[str]:
    """The character by which the vocabulary writes each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in signs:
            signs[b] = chr(256 + extra)
            extra += 1
    return [signs[b] for b in range(256)]


class Encoder:
    """Encodes text by a byte-level vocabulary whose ids ascend in the order of merging."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merged[a, b] = whole
            self.halves.setdefault(whole, (a, b))
        self.automaton = ahocorasick.Automaton()
        made = set(self.halves)
        for sign in _byte_signs():
            made.add(ids[sign])
        for text, number in ids.items():
            if number in made:
                self.automaton.add_word(text, (number, len(text)))
        self.automaton.make_automaton()
        self.signs = dict(enumerate(_byte_signs()))
        self.pieces = regex.compile(PIECES)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens.

        They don't if, somewhere on the way of building both, the parts that touch would have merged before the merge
        that takes one of them away. The way is walked backwards, always undoing the later of the two merges."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[left, right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        # Merges from this id on come after the parts in hand have been taken away.
        bound = 1 << 60
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and whole < bound:
                return False
            undo_left = left > right
            part = self.halves.get(left if undo_left else right)
            if part is None:
                # A single byte can't be undone; the other side may still be.
                undo_left = not undo_left
                part = self.halves.get(left if undo_left else right)
                if part is None:
                    return True
            if undo_left:
                bound, left = left, part[1]
            else:
                bound, right = right + 1, part[0]

    def encode_piece(self, piece: str) -> list[int]:
        signs = self.signs
        written = "".join([signs[b] for b in piece.encode("utf-8", "surrogatepass")])
        last = [-1] * len(written)
        start = [0] * len(written)
        for end, (token, length) in self.automaton.iter(written):
            if last[end] >= 0:
                continue
            begin = end - length + 1
            if begin == 0 or (last[begin - 1] >= 0 and self.compatible(last[begin - 1], token)):
                last[end], start[end] = token, begin
        out, at = [], len(written) - 1
        while at >= 0:
            out.append(last[at])
            at = start[at] - 1
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; empty for a null or empty text."""
        if not text:
            return []
        known, out = self._known, []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@cache
def encoder(tokenizers: str = TOKENIZERS, name: str = BYTE_BPE) -> Encoder:
    """The encoder of a vocabulary file, built once in each worker."""
    return Encoder(os.path.join(tokenizers, name))


def tokenise(df: DataFrame, text: str = "text", ids: str = "ids", tokenizers: str = TOKENIZERS) -> DataFrame:
    """`df` with the column `ids`, the ids of its text, in place of the text. Null and empty texts give an empty list.
    A column that has the name already is replaced. Whole texts are encoded where they are; nothing is shuffled."""
    keep = [c for c in df.columns if c not in (text, ids)]
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizers).encode
        for batch in batches:
            lists = [np.asarray(encode(t), dtype=np.int32) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], column], names=[*keep, ids])

    return df.mapInArrow(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{ids}` array<int>"]))


def count_tokens(df: DataFrame, text: str = "text", size: str = "n_tokens", tokenizers: str = TOKENIZERS) -> DataFrame:
    """`df` with the column `size`, the number of tokens of its text, in place of the text and of a column that has the
    name already."""
    keep = [c for c in df.columns if c not in (text, size)]
    kinds = dict(df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizers).encode
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], sizes], names=[*keep, size])

    return df.mapInArrow(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{size}` bigint"]))

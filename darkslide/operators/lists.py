"""Several values packed in one string, split into rows with their position.

The kernel works on the Arrow buffers of a batch: one pass of array operations marks quotes and delimiters, the parity
of quotes says which delimiters count, and the remaining ones are the child offsets. No value is looked at alone, but
for bracketed lists (JSON, or a printed Python list), whose escapes need a parser."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# What separates two values outside quotes, as UTF-8.
DELIMITERS = [";", ",", "|", "\t", "\n", "\r", "•", "，", "、", "；", " / "]
QUOTE = ord('"')


def _bracketed(text: str) -> list[str] | None:
    """The items of a JSON or printed Python list; None if it isn't one."""
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(got, list | tuple):
            return ["" if x is None else x if isinstance(x, str) else str(x) for x in got]
    return None


def split_lists(values: pa.StringArray, bar_joins: pa.BooleanArray) -> pa.ListArray:
    """A list of items for each value: outside quotes every delimiter splits, one layer of quoting and the outer blanks
    are taken off, empty items are dropped, order and repetitions stay. Where `bar_joins`, the bar is no delimiter.

    Null, empty and blank values give an empty list. A value with an odd number of quotes has none that open, so its
    quotes are ordinary characters."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    n = len(values)
    _, offsets_buffer, data_buffer = values.buffers()
    offsets = np.zeros(1, np.int64)
    if n:  # a slice shares the buffers of its array
        offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[values.offset : values.offset + n + 1]
    total = int(offsets[-1] - offsets[0])
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if total else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    parent = np.repeat(np.arange(n), lengths)

    quotes = np.concatenate(([0], np.cumsum(data == QUOTE)))
    before = quotes[offsets[:-1]]
    balanced = ((quotes[offsets[1:]] - before) % 2 == 0) if n else np.zeros(0, bool)
    outside = ((quotes[:-1] - before[parent]) % 2 == 0) | ~balanced[parent]

    trimmed = pc.utf8_trim_whitespace(values)
    listed = pc.and_(pc.starts_with(trimmed, "["), pc.ends_with(trimmed, "]")).to_numpy(zero_copy_only=False)
    own = ~listed
    bars = bar_joins.fill_null(False).to_numpy(zero_copy_only=False)

    starts, ends = [], []
    for mark in DELIMITERS:
        raw = np.frombuffer(mark.encode(), np.uint8)
        if total < len(raw):
            continue
        hit = np.ones(total - len(raw) + 1, bool)
        for k, byte in enumerate(raw):
            hit &= data[k : total - len(raw) + 1 + k] == byte
        at = np.flatnonzero(hit)
        at = at[outside[at] & own[parent[at]]]
        if len(raw) > 1:  # a mark doesn't span two values
            at = at[parent[at] == parent[at + len(raw) - 1]]
        if mark == "|":
            at = at[~bars[parent[at]]]
        starts.append(at)
        ends.append(at + len(raw))
    cut = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    resume = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    plain = np.flatnonzero(own)
    first = np.concatenate((offsets[plain], resume))
    last = np.concatenate((offsets[plain + 1], cut))
    owner = np.concatenate((plain, parent[cut])) if len(cut) else plain
    # The k-th start of a value belongs to its k-th end: both ascend within it.
    by_start = np.lexsort((first, owner))
    by_end = np.lexsort((last, owner))
    first, last, owner = first[by_start], np.maximum(last[by_end], first[by_start]), owner[by_start]

    sizes = last - first
    child_offsets = np.concatenate(([0], np.cumsum(sizes)))
    gather = np.repeat(first - child_offsets[:-1], sizes) + np.arange(child_offsets[-1])
    children = pa.LargeStringArray.from_buffers(
        len(sizes), pa.py_buffer(child_offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[gather]))
    )
    children = _unquoted(pc.utf8_trim_whitespace(children))

    if listed.any():
        which = np.flatnonzero(listed)
        items, counts = [], []
        for text in trimmed.take(pa.array(which)).to_pylist():
            got = _bracketed(text)
            if got is None:
                got = split_lists(pa.array([text[1:-1]]), pa.array([False])).to_pylist()[0]
            got = [x.strip() for x in got]
            items.extend(got)
            counts.append(len(got))
        children = pa.concat_arrays([children, pa.array(items, pa.large_string())])
        owner = np.concatenate((owner, np.repeat(which, counts)))
        order = np.argsort(owner, kind="stable")
        owner, children = owner[order], children.take(pa.array(order))

    full = pc.not_equal(children, "").to_numpy(zero_copy_only=False)
    owner, children = owner[full], children.filter(pa.array(full))
    per_value = np.bincount(owner, minlength=n) if n else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(per_value))), pa.int32()), children.cast(pa.string())
    )


def _unquoted(items: pa.Array) -> pa.Array:
    quoted = pc.and_(
        pc.and_(pc.starts_with(items, '"'), pc.ends_with(items, '"')), pc.greater_equal(pc.binary_length(items), 2)
    )
    if not pc.any(quoted).as_py():
        return items
    inner = pc.replace_substring(pc.utf8_slice_codeunits(items, 1, -1), '""', '"')
    return pc.utf8_trim_whitespace(pc.if_else(quoted, inner, items))


def explode_lists(df: DataFrame, value: str = "value", hierarchical: str = "hierarchical") -> DataFrame:
    """The other columns of `df`, then pos (from 1) and item, for each item packed in column `value`.

    Rows whose value holds no item give no row. A column of `df` named pos or item is replaced. The work is one
    narrow stage: rows are split where they are, whatever value is common, and nothing is shuffled."""
    keep = [c for c in df.columns if c not in (value, hierarchical, "pos", "item")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_lists(batch.column(value), batch.column(hierarchical))
            ordinals = pc.list_parent_indices(lists)
            starts = np.asarray(lists.offsets)[:-1]
            rows = np.asarray(ordinals)
            pos = np.arange(len(rows)) - starts[rows] + 1
            out = [batch.column(c).take(ordinals) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(pos, pa.int32()), lists.flatten()], names=[*keep, "pos", "item"]
            )

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", pos int, item string"
    return df.mapInArrow(split, schema)

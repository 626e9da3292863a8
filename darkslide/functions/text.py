"""Text functions: ASCII collation, the tokenizer of the full-text index, and the text that is indexed."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
MARKS = "[̀-ͯ]"


@functools.cache
def accents() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F that are one letter with one mark, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) == 2]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only: the collation of names and prefixes."""
    return F.translate(c, UPPER, UPPER.lower())


def folded(c: Column) -> Column:
    """Lower case without the marks of single accents."""
    source, target = accents()
    return F.lower(F.translate(F.regexp_replace(c, MARKS, ""), source, target))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and private characters of the folded text, in order; null gives no tokens."""
    return cut(folded(F.coalesce(c, F.lit(""))))


def cut(text: Column) -> Column:
    """The tokens of a folded text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """How many tokens a text has. Folding changes letters, not where tokens end, but for marks of their own."""
    return F.regexp_count(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, ""), F.lit(TOKEN))


def fold_query(text: str) -> list[str]:
    """The tokens of a query's text, by the same rules, on the driver."""
    import regex

    source, target = accents()
    plain = regex.sub(MARKS, "", text).translate(str.maketrans(source, target)).lower()
    return regex.findall(TOKEN, plain)


def json_object(metadata: Column) -> Column:
    """A map as one JSON object with a blank after each comma and colon, in the order of the map; null values are null."""

    def quoted(c: Column) -> Column:
        text = F.to_json(F.array(c))
        return F.when(c.isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))

    pairs = F.transform(F.map_entries(metadata), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def pretty_json(metadata: Column) -> Column:
    """A map as JSON, one entry a line, indented by two."""
    body = F.regexp_replace(F.to_json(metadata, {"pretty": "true"}), '" : ', '": ')
    return F.when(F.size(metadata) == 0, "{}").otherwise(body)


def metadata_text(metadata: Column) -> Column:
    """What is indexed of a map: keys and values in order, then the map as JSON."""
    words = F.flatten(F.transform(F.map_entries(metadata), lambda e: F.array(e["key"], e["value"])))
    return F.concat_ws(" ", F.concat_ws(" ", words), json_object(metadata))


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.when(filename.contains("."), ascii_lower(F.substring_index(filename, ".", -1))).otherwise("")


def find_all(text: Column, needle: str) -> Column:
    """Start positions, from 0, of all occurrences regardless of case, overlapping ones too."""
    if not needle:
        return F.array().cast("array<int>")
    low = needle.lower()

    def starts(text: str | None) -> list[int]:
        found, at = [], text.find(low) if text else -1
        while at >= 0:
            found.append(at)
            at = text.find(low, at + 1)
        return found

    @F.arrow_udf("array<int>")
    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array([starts(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return kernel(F.lower(text))


def step(positions: list[int], at: int, forward: bool = True) -> int:
    """Which hit is shown after hit number `at`, going round at either end; -1 without any hit. A new search starts
    forward from -1 and backward from the number of hits."""
    return (at + (1 if forward else -1)) % len(positions) if positions else -1


def merged_ranges(starts: Column, length: int) -> Column:
    """(start, end) of the occurrences that don't begin inside the one kept before them."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(kept: Column, s: Column) -> Column:
        new = F.struct(s.alias("start"), (s + length).cast("int").alias("end"))
        free = (F.size(kept) == 0) | (s >= F.element_at(kept, -1)["end"])
        return F.when(free, F.concat(kept, F.array(new))).otherwise(kept)

    return F.aggregate(starts, empty, step)


def highlighted(text: Column, needle: str, colour: str = "#fff176") -> Column:
    """The text as HTML with every kept occurrence of `needle` in a coloured span."""

    def escaped(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    ranges = merged_ranges(find_all(text, needle), len(needle))
    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))

    def step(done: Column, r: Column) -> Column:
        plain = escaped(F.substring(text, done["at"] + 1, r["start"] - done["at"]))
        marked = escaped(F.substring(text, r["start"] + 1, r["end"] - r["start"]))
        span = F.concat(F.lit(f'<span style="background-color:{colour}">'), marked, F.lit("</span>"))
        return F.struct(F.concat(done["html"], plain, span).alias("html"), r["end"].alias("at"))

    return F.aggregate(
        ranges,
        start,
        step,
        lambda d: F.concat(d["html"], escaped(F.substring(text, d["at"] + 1, F.length(text)))),
    )

"""Search, count and facets over the catalogue and its index."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkslide.functions.text import ascii_lower, cut, extension, folded, token_count
from darkslide.plans import match
from darkslide.plans.index import Stored
from darkslide.sources.tables import shuffle_partitions, spread, written

# Extensions that a filter also takes, and the named orders.
ALIASES = {"jpg": ("jpg", "jpeg")}
MERGED = {"jpeg": "jpg"}
ORDERS = {
    "filename_asc": ("filename", False, True),
    "filename_desc": ("filename", True, True),
    "path_asc": ("path", False, True),
    "path_desc": ("path", True, True),
    "date_desc": ("mtime", True, False),
    "date_asc": ("mtime", False, False),
    "size_desc": ("size", True, False),
}
DEFAULT_ORDER = "filename_asc"
RESULT = ["id", "path", "filename", "metadata_json", "size", "mtime"]


@dataclass
class Request:
    query: str = ""
    ext: str = ""
    folder: str = ""
    excluded: list[str] = field(default_factory=list)
    sort: str = ""
    limit: int | None = None
    offset: int = 0


def under(path: Column, folder: str) -> Column:
    """Whether a path lies below a folder: the folder is normalised and a separator follows it, and A to Z compare
    regardless of case. The folder is taken literally, % and _ are ordinary characters."""
    return ascii_lower(path).startswith(posixpath.normpath(folder).lower() + "/" if folder.isascii() else
                                        _lower(posixpath.normpath(folder)) + "/")


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def has_extension(filename: Column, ext: str) -> Column:
    name = ext.lower().lstrip(".")
    out = F.lit(False)
    for e in ALIASES.get(name, (name,)):
        out = out | ascii_lower(filename).endswith("." + e)
    return out


def folded_texts(index: DataFrame) -> DataFrame:
    """The index with its folded texts, each folded once: the generator keeps the optimiser from copying the folding into
    every condition on it."""
    made = F.struct(*[folded(F.coalesce(F.col(c), F.lit(""))).alias(f"__{c}") for c in match.COLUMNS])
    return spread(index, "id").select("id", F.explode(F.array(made)).alias("__t")).select("id", "__t.*")


def with_tokens(texts: DataFrame) -> DataFrame:
    """Folded texts cut into arrays of tokens; behind a generator too, or the cutting would run again for each position
    of a phrase."""
    made = F.struct(*[cut(F.col(f"__{c}")).alias(f"__{c}") for c in match.COLUMNS])
    return texts.select("id", F.explode(F.array(made)).alias("__t")).select("id", "__t.*")


def tokenised(index: DataFrame) -> DataFrame:
    """The index with an array of tokens for each of its columns."""
    return with_tokens(folded_texts(index))


def token_columns() -> dict[str, Column]:
    return {c: F.col(f"__{c}") for c in match.COLUMNS}


def filtered(images: DataFrame, r: Request, with_ext: bool = True) -> DataFrame:
    """The pictures that pass the filters other than the text."""
    if with_ext and r.ext:
        images = images.where(has_extension(F.col("filename"), r.ext))
    if r.folder:
        images = images.where(under(F.col("path"), r.folder))
    for folder in r.excluded:
        images = images.where(~under(F.col("path"), folder))
    return images


def hits(images: DataFrame, index: DataFrame | Stored, r: Request, with_ext: bool = True) -> DataFrame:
    """The pictures that match the request. A blank query puts no condition on the text; any other is looked up in
    a stored index, or else scanned for in the texts, and only the ids of what matches are joined."""
    rows = filtered(images, r, with_ext)
    if not r.query.strip():
        return rows
    node = match.parse(r.query)
    if isinstance(index, Stored):
        found = index.matching(node)
    else:
        found = candidates(index, node).where(match.matches(node, token_columns()))
    return rows.join(found.select("id"), "id", "left_semi")


def candidates(index: DataFrame, node: match.Node | None) -> DataFrame:
    """The tokens of the rows that can match: the others are never cut into tokens."""
    return with_tokens(folded_texts(index).where(match.plausible(node, token_columns())))


def statistics(index: DataFrame, node: match.Node | None) -> tuple[dict[match.Phrase, float], float]:
    """The weight of each phrase and the average length: tokens are only counted in all rows, and matched in those that
    hold them."""
    found = sorted(set(match.phrases(node)), key=repr)
    length = F.lit(0)
    for c in match.COLUMNS:
        length = length + token_count(F.col(c))
    row = spread(index, "id").agg(F.count("*").alias("n"), F.avg(length).alias("average")).first()
    columns = token_columns()
    weights: dict[match.Phrase, float] = {}
    if found:
        any_of = found[0]
        for p in found[1:]:
            any_of = match.Either(any_of, p)
        counts = [F.count_if(match.phrase_matches(p, columns)) for p in found]
        for p, df in zip(found, candidates(index, any_of).agg(*counts).first(), strict=True):
            weights[p] = match.weight(row["n"], df)
    return weights, row["average"] or 1.0


def ordering(name: str) -> list[Column]:
    """A named order; unknown names mean the default. Paths break ties, so that pages don't depend on row order."""
    column, down, text = ORDERS.get(name, ORDERS[DEFAULT_ORDER])
    key = ascii_lower(F.col(column)) if text else F.col(column)
    return [key.desc() if down else key.asc(), F.col("path").asc()]


def places(rows: DataFrame, name: str) -> DataFrame:
    """(id, place) of every row in a named order. Rows are dealt out by ranges of the order and counted in each, so no
    task orders them all; paths are part of the order, so rows with one name or time can be parted too."""
    column = ORDERS.get(name, ORDERS[DEFAULT_ORDER])[0]
    dealt = rows.select("id", *{"path", column}).repartitionByRange(shuffle_partitions(rows.sparkSession), *ordering(name))
    dealt = written(dealt.withColumn("__part", F.spark_partition_id()), "places")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*ordering(name)))
    return dealt.join(F.broadcast(offsets), "__part").select("id", place.alias("place"))


def search(images: DataFrame, index: DataFrame | Stored, r: Request) -> DataFrame:
    """The results in order: by rank if there is a query and no order was asked for, else by the named order."""
    ranked = bool(r.query.strip()) and not r.sort
    if ranked:
        node = match.parse(r.query)
        if isinstance(index, Stored):
            scored = index.scored(node)
        else:
            weights, average = statistics(index, node)
            scored = (
                candidates(index, node)
                .where(match.matches(node, token_columns()))
                .select("id", match.score(node, token_columns(), weights, average).alias("score"))
            )
        rows = filtered(images, r).join(scored, "id")
        rows = rows.orderBy("score", "path").select(*RESULT, "score")
    else:
        rows = hits(images, index, r).orderBy(*ordering(r.sort)).select(*RESULT)
    if r.offset:
        rows = rows.offset(r.offset)
    return rows if r.limit is None else rows.limit(r.limit)


def count(images: DataFrame, index: DataFrame | Stored, r: Request) -> DataFrame:
    return hits(images, index, r).agg(F.count("*").alias("n"))


def facets(images: DataFrame, index: DataFrame | Stored, r: Request) -> DataFrame:
    """(ext, n) of the formats among the matches, whatever extension is asked for; names without one don't count."""
    ext = extension(F.col("filename"))
    merged = F.coalesce(*[F.when(ext == a, F.lit(b)) for a, b in MERGED.items()], ext)
    return (
        hits(images, index, r, with_ext=False)
        .where(merged != "")
        .groupBy(merged.alias("ext"))
        .agg(F.count("*").alias("n"))
    )

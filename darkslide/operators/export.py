"""Exports: tag rows, distinct keys, wide CSV, JSON and the work-list of thumbnails."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.entries import tag_map
from darkslide.functions.text import json_object

LARGEST_SOURCE = 1 << 30


def tag_rows(images: DataFrame) -> DataFrame:
    """(id, tag, value): one row per entry of the metadata; malformed or other JSON has none."""
    return images.select("id", F.explode(tag_map(F.col("metadata_json"))).alias("tag", "value"))


def distinct_keys(images: DataFrame) -> DataFrame:
    return tag_rows(images).select("tag").distinct()


def tag_table(images: DataFrame, number: int) -> DataFrame:
    """(tag, value) of one picture, as they are shown: by the tag in lower case."""
    return tag_rows(images.where(F.col("id") == number)).select("tag", "value").orderBy(F.lower("tag"), "tag")


def wide_csv(images: DataFrame) -> DataFrame:
    """path, filename, then a column for each distinct key in order, missing values empty. Objects within the metadata are
    flattened. A key named like one of the first two columns overrides it; one that differs from another only in case gets a number. The keys become columns, so the driver reads them: they are the schema."""
    # The map is built once a row, behind generators, and flattened only where there is an object to flatten: each column
    # then only looks its key up.
    made = images.select("path", "filename", "metadata_json", F.explode(F.array(tag_map(F.col("metadata_json")))).alias("__m"))
    nested = F.exists(F.map_values("__m"), lambda v: v.startswith("{"))
    flat = F.when(F.coalesce(nested, F.lit(False)), flattened(F.col("metadata_json"))).otherwise(F.col("__m"))
    rows = made.select("path", "filename", F.explode(F.array(flat)).alias("m"))
    keys = sorted(r["tag"] for r in rows.select(F.explode(F.map_keys("m")).alias("tag")).distinct().collect())
    first = [
        (F.coalesce(F.try_element_at("m", F.lit(c)), F.col(c)) if c in keys else F.col(c)).alias(c)
        for c in ("path", "filename")
    ]
    taken, rest = {"path", "filename"}, []
    for k in keys:
        if k in ("path", "filename"):
            continue
        name, n = k, 1
        while name.lower() in taken:
            n += 1
            name = f"{k} ({n})"
        taken.add(name.lower())
        rest.append(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(name))
    return rows.select(*first, *rest)


def json_rows(images: DataFrame) -> DataFrame:
    """One row per picture with its metadata as a nested object, ready for write.json."""
    return images.select("path", "filename", "mtime", "size", tag_map(F.col("metadata_json")).alias("metadata"))


def flattened(document: Column) -> Column:
    """A map of group:key to value from a JSON object: objects within it are flattened one level, other values are kept
    as they are, and of keys that are then equal the last counts. Anything but an object gives an empty map."""
    outer = F.map_entries(F.from_json(document, "map<string,string>"))
    inner = F.transform(
        outer,
        lambda e: F.coalesce(
            F.map_entries(
                F.transform_keys(
                    F.from_json(F.when(e["value"].startswith("{"), e["value"]), "map<string,string>"),
                    lambda k, _: F.concat_ws(":", e["key"], k),
                )
            ),
            F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        ),
    )
    flat = F.coalesce(F.flatten(inner), F.array().cast("array<struct<key:string,value:string>>"))
    keys = F.transform(flat, lambda e: e["key"])
    last = F.filter(flat, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)
    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), flat).otherwise(last)
    return F.map_from_entries(unique)


def write_csv(rows: DataFrame, path: str) -> None:
    """Writes search results as CSV below `path`, in their order, with a header in each file and empty cells for missing
    values."""
    wide_csv(rows).write.mode("error").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_json(images: DataFrame, path: str, cancelled: bool = False) -> bool:
    """Writes one JSON object per picture and line below `path`; nothing after a run that was cancelled. Tells whether it
    wrote."""
    if not cancelled:
        json_rows(images).write.mode("error").json(path)
    return not cancelled


def cache_names(images: DataFrame) -> DataFrame:
    """`images` plus cache_name, the name of a thumbnail: a digest of path, time and size, the time as Python writes
    it."""
    kinds = dict(images.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "mtime", "size")), strict=True)
            names = [hashlib.sha1(f"{p}|{m!r}|{s}".encode()).hexdigest() + ".png" for p, m, s in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "cache_name"]
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in images.columns) + ", cache_name string"
    return images.mapInArrow(work, schema)


def listed_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the thumbnails and marks in a folder of the cache; a missing folder has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,skip}").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def _outside(images: DataFrame, excluded: list[str] | None) -> DataFrame:
    """The pictures outside the folders, which are normalised and followed by a separator: a folder whose name only
    begins like an excluded one isn't excluded."""
    for folder in excluded or []:
        images = images.where(~F.col("path").startswith(posixpath.normpath(folder) + "/"))
    return images


def thumbnail_worklist(images: DataFrame, cached: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """The pictures without a thumbnail or a mark that they can't have one, outside the excluded folders. Pictures above
    the size that is decoded are left out; a picture of unknown size is tried. `cached` has the column name, of .png
    files and .skip marks."""
    have = cached.select(F.regexp_replace("name", r"\.skip$", ".png").alias("cache_name")).distinct()
    rows = _outside(images, excluded).where(F.coalesce(F.col("size") <= LARGEST_SOURCE, F.lit(True)))
    return cache_names(rows).join(have, "cache_name", "left_anti")


def thumbnail_counters(images: DataFrame, cached: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(total, cached, missing): the pictures outside the excluded folders, those with a thumbnail or a mark, and the
    others."""
    have = cached.select(F.regexp_replace("name", r"\.skip$", ".png").alias("cache_name"), F.lit(True).alias("have")).distinct()
    rows = cache_names(_outside(images, excluded).select("path", "mtime", "size")).join(have, "cache_name", "left")
    ready = F.count_if(F.coalesce("have", F.lit(False)))
    return rows.agg(F.count("*").alias("total"), ready.alias("cached"), (F.count("*") - ready).alias("missing"))

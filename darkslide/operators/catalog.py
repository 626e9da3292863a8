"""The catalogue of pictures: what a scan changes in it, as plans over immutable tables, and snapshot commits."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkslide.functions.text import ascii_lower
from darkslide.plans.search import under
from darkslide.sources.tables import guard, union

STAMP = ["path", "mtime", "size"]


def stamps(images: DataFrame) -> DataFrame:
    return images.select(*STAMP)


def changes(scan: DataFrame, images: DataFrame) -> DataFrame:
    """`scan` plus status: unchanged where the stamp of the same path is exactly equal, changed where it differs, new
    where the path is unknown."""
    known = images.select(F.col("path").alias("__p"), F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    same = (F.col("mtime") == F.col("__m")) & (F.col("size") == F.col("__s"))
    status = F.when(F.col("__p").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return scan.join(known, F.col("path") == F.col("__p"), "left").select(*[scan[c] for c in scan.columns],
                                                                          status.alias("status"))


def last_by_path(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per path: the last in `order`."""
    newest = Window.partitionBy("path").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def upsert(images: DataFrame, incoming: DataFrame) -> DataFrame:
    """`images` with the rows of `incoming` (one per path) in place of those with the same path, which keep their id;
    new paths get a hash of the path as id."""
    ids = images.select(F.col("path").alias("__p"), F.col("id").alias("__id"))
    taken = incoming.join(ids, F.col("path") == F.col("__p"), "left")
    rows = [
        F.coalesce("__id", F.xxhash64("path")).alias("id") if c == "id" else F.col(c) for c in images.columns
    ]
    kept = images.join(incoming.select("path"), "path", "left_anti").select(*images.columns)
    return union(kept, taken.select(*rows))


def below_any(path: Column, roots: list[str]) -> Column:
    """Whether a path lies below one of the scanned roots, which are taken as given, without normalising."""
    out = F.lit(False)
    for root in roots:
        prefix = root if root.endswith("/") else root + "/"
        out = out | ascii_lower(path).startswith("".join(c.lower() if c.isascii() else c for c in prefix))
    return out


def delete_missing(images: DataFrame, kept: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """`images` without the rows whose path isn't in `kept`; with roots, only rows below one of them are deleted."""
    paths = kept.select("path").distinct()
    if not roots:
        return images.join(paths, "path", "left_semi").select(*images.columns)
    scoped = images.where(below_any(F.col("path"), roots))
    others = images.where(~below_any(F.col("path"), roots))
    return union(others, scoped.join(paths, "path", "left_semi").select(*images.columns))


def delete_below(images: DataFrame, folder: str) -> DataFrame:
    return images.where(~under(F.col("path"), folder))


def force_wipe(images: DataFrame, roots: list[str]) -> DataFrame:
    """`images` without every row below the roots, as before a full scan."""
    return images.where(~below_any(F.col("path"), roots))


def run_counters(scanned: DataFrame) -> DataFrame:
    """(indexed, errors) of a scan with a column status; unchanged files count as indexed."""
    return scanned.agg(
        F.count_if(F.col("status") != "error").alias("indexed"), F.count_if(F.col("status") == "error").alias("errors")
    )


class Conflict(RuntimeError):
    """Someone else committed since the catalogue was read."""


class Catalog:
    """A catalogue kept as one Parquet folder per version of a table, and numbered pointers that name the current ones.

    A version is written whole before its pointer is made, so readers see the old or the new tables and a job that dies
    leaves the old ones. Pointers are files that are created and never replaced: of two writers that both follow the same
    pointer one fails. Tables and pointers are reached through Hadoop's file systems, so a catalogue can lie wherever
    Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = guard(spark), root
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(root))

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path())]
        return sorted((int(n[8:-5]) for n in names if n.startswith("CURRENT-") and n.endswith(".json")), reverse=True)

    def current(self) -> tuple[int, dict[str, str]]:
        """(number of the pointer, folder of each table); 0 and nothing before the first commit. A pointer that is just
        being written doesn't count yet."""
        for number in self._numbers():
            file = self._fs.open(self._path(f"CURRENT-{number}.json"))
            try:
                said = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            finally:
                file.close()
            try:
                return number, json.loads(said)
            except ValueError:
                continue
        return 0, {}

    def read(self, name: str = "images") -> DataFrame | None:
        folder = self.current()[1].get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def commit(self, after: int | None = None, **tables: DataFrame) -> None:
        """Writes new versions of the tables and makes all of them current at once. With `after`, the number of the pointer
        that the tables were made from, it fails if there is a later one."""
        number, current = self.current()
        if after is not None and number != after:
            raise Conflict(f"the catalogue is at {number}, not at {after}")
        for name, df in tables.items():
            current[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{current[name]}")
        pointer = self._path(f"CURRENT-{number + 1}.json")
        try:
            file = self._fs.create(pointer, False)
        except Exception as taken:
            raise Conflict(f"pointer {number + 1} was made by someone else") from taken
        try:
            file.write(bytearray(json.dumps(current).encode()))
        finally:
            file.close()

    def clear(self) -> None:
        """Empties every table, keeping its columns."""
        self.commit(**{n: self.read(n).limit(0) for n in self.current()[1]})


def normalised(path: str) -> str:
    return posixpath.normpath(path)

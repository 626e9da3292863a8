"""The registry of folders and the life of a folder."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.paths import with_longest_folder
from darkslide.functions.text import ascii_lower
from darkslide.sources.tables import union

COLUMNS = [
    "id",
    "path",
    "display_name",
    "enabled",
    "recursive",
    "status",
    "image_count",
    "last_scanned_at",
    "error_message",
]
PENDING = ["queued", "scanning"]

# What each event does to a folder's status.
TRANSITIONS = {
    ("new", "queue"): "queued",
    ("indexed", "queue"): "queued",
    ("error", "queue"): "queued",
    ("queued", "start"): "scanning",
    ("scanning", "finish"): "indexed",
    ("scanning", "fail"): "error",
    ("scanning", "cancel"): "new",
    ("queued", "cancel"): "new",
    ("scanning", "close"): "queued",
}


def transition(status: str, event: str) -> str:
    """The status after an event. Disabling and enabling work from any status; other events not listed change nothing."""
    if event == "disable":
        return "disabled"
    if event == "enable":
        return "indexed"
    return TRANSITIONS.get((status, event), status)


def next_in_queue(queue: list[tuple[int, bool]], request: tuple[int, bool]) -> list[tuple[int, bool]]:
    """The queue of (folder, force) with a request at its end, unless it waits already."""
    return queue if request in queue else [*queue, request]


def everything(registry: DataFrame) -> DataFrame:
    return registry.select(*COLUMNS).orderBy("path")


def by_id(registry: DataFrame, number: int) -> DataFrame:
    """The folder with that number, or no row."""
    return registry.select(*COLUMNS).where(F.col("id") == number)


def exists(registry: DataFrame, path: str) -> bool:
    """Whether a path is registered, once it is normalised."""
    return registry.where(F.col("path") == posixpath.normpath(path)).limit(1).count() > 0


def cleared(registry: DataFrame) -> DataFrame:
    return registry.limit(0)


def enabled(registry: DataFrame) -> DataFrame:
    return registry.where("enabled").orderBy("path")


def disabled_paths(registry: DataFrame) -> DataFrame:
    return registry.where(~F.col("enabled")).select("path")


def outside_disabled(images: DataFrame, registry: DataFrame) -> DataFrame:
    """The pictures outside all disabled folders: joins by the folder above at each depth, not a list of conditions. A to
    Z compare regardless of case, as in other filters of folders."""
    off = disabled_paths(registry).select(ascii_lower(F.col("path")).alias("path"), F.lit(True).alias("off"))
    rows = images.withColumn("__low", ascii_lower(F.col("path")))
    marked = with_longest_folder(rows, off, "__low", {"off": "__off"})
    return marked.where(F.col("__off").isNull()).drop("__low", "__off")


def pending(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("enabled") & F.col("status").isin(PENDING)).orderBy("path")


def add(registry: DataFrame, path: str, display_name: str = "", recursive: bool = True) -> DataFrame:
    """The registry with a folder, unless its normalised path is registered already."""
    path = posixpath.normpath(path)
    name = display_name or re.split(r"[/\\]", path)[-1]
    if registry.where(F.col("path") == path).limit(1).count():
        return registry
    number = (registry.agg(F.max("id")).first()[0] or 0) + 1
    row = registry.sparkSession.createDataFrame(
        [(number, path, name, True, recursive, "new", 0, None, None)], registry.select(*COLUMNS).schema
    )
    return union(registry.select(*COLUMNS), row)


def remove(registry: DataFrame, number: int) -> DataFrame:
    return registry.where(F.col("id") != number)


def set_enabled(registry: DataFrame, number: int, on: bool) -> DataFrame:
    mine = F.col("id") == number
    return registry.withColumns(
        {
            "enabled": F.when(mine, F.lit(on)).otherwise(F.col("enabled")),
            "status": F.when(mine, F.lit("indexed" if on else "disabled")).otherwise(F.col("status")),
        }
    )


def update_status(
    registry: DataFrame,
    number: int,
    status: str,
    image_count: int = 0,
    last_scanned_at: float | None = None,
    error_message: str | None = None,
) -> DataFrame:
    """The registry with a folder's new status. Count, time and message are overwritten, with their defaults too; the
    time defaults to now."""
    mine = F.col("id") == number
    at = F.lit(last_scanned_at) if last_scanned_at is not None else F.unix_timestamp().cast("double")
    new = {
        "status": F.lit(status),
        "image_count": F.lit(image_count).cast("bigint"),
        "last_scanned_at": at,
        "error_message": F.lit(error_message).cast("string"),
    }
    return registry.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})

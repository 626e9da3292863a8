"""Folder counts and the folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.sources.tables import written


def folder_counts(images: DataFrame) -> DataFrame:
    """(folder, n): pictures that lie directly in each folder."""
    parent = F.substring(
        "path", F.lit(1), F.greatest(F.length("path") - F.length("filename") - 1, F.lit(0))
    )
    return images.groupBy(parent.alias("folder")).agg(F.count("*").alias("n"))


def folder_tree(images: DataFrame) -> DataFrame:
    """(path, name, depth, n): every folder from the deepest common one down to those with pictures, with the pictures
    that lie directly in it. Depth counts from the common folder, or from the roots where drives differ.

    The tree is built from the distinct folders, not from the pictures, so a folder that holds most pictures is one row
    by then; they are written once, as finding the deepest common folder reads them before the tree does. That folder is
    the longest prefix that all of them have."""
    counts = written(folder_counts(images), "folders")
    # A root is one part: /, a drive, or the server and share of \\server\share.
    parts = F.split(F.translate("folder", "\\", "/"), "/")
    first = F.least(F.when(F.col("folder").startswith("\\\\"), 4).otherwise(1), F.size(parts))
    steps = F.filter(F.sequence(first, F.size(parts)), lambda i: (i == first) | (F.get(parts, i - 1) != ""))
    prefixes = counts.where("folder <> ''").select(
        "folder", F.explode(F.transform(steps, lambda i: F.struct(
            (i - first + 1).alias("level"),
            F.greatest(F.length(F.array_join(F.slice(parts, 1, i), "/")), F.lit(1)).alias("width")))).alias("s")
    ).select(F.substring("folder", F.lit(1), F.col("s.width")).alias("path"), F.col("s.level").alias("level"))
    nodes = prefixes.groupBy("path").agg(F.first("level").alias("level"), F.count("*").alias("below"))
    edges = nodes.agg(F.max("below").alias("m"), F.min("level").alias("least")).first()
    total = counts.where("folder <> ''").count()
    common = nodes.where(F.col("below") == total).agg(F.max("level").alias("level")).first()["level"]
    base = common if common is not None else edges["least"] or 0
    return (
        nodes.where(F.col("level") >= base)
        .join(counts.withColumnRenamed("folder", "path"), "path", "left")
        .select(
            "path",
            F.when(F.col("level") == 1, F.col("path"))
            .otherwise(F.substring_index(F.translate("path", "\\", "/"), "/", -1)).alias("name"),
            (F.col("level") - base).cast("int").alias("depth"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )

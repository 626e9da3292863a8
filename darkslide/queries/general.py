"""The queries of the general data-preparation operators over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.entries import entries
from darkslide.functions.paths import with_longest_folder
from darkslide.operators.lists import explode_lists
from darkslide.operators.snapshots import snapshot_changes
from darkslide.operators.timestamps import normalise_times
from darkslide.operators.units import harmonise, judged_sources
from darkslide.operators.wide import unreadable, widen
from darkslide.sources.tables import spread, table, union

TIME_NAMES = ["DateTimeOriginal", "CreateDate", "ModifyDate", "DateCreated", "CreationTime", "GPSDateTime"]
LIST_NAMES = ["Keywords", "Subject", "XPKeywords", "HierarchicalSubject"]
QUANTITY_NAMES = [
    "FocalLength",
    "ExposureTime",
    "GPSAltitude",
    "SubjectDistance",
    "CameraTemperature",
    "FileSize",
    "XResolution",
]


def p1_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time of the images as an instant, with the reading chosen and whether it stayed ambiguous. A source is a tag
    as a make of camera writes it, the tag is its family."""
    zones = table(spark, sf_dir, "folder_zones").groupBy("folder_id").agg(F.min("zone_name").alias("zone_name"))
    folders = table(spark, sf_dir, "indexed_folders").select("id", "path")
    folders = folders.join(zones, folders["id"] == zones["folder_id"], "left").select("path", "zone_name")
    images = with_longest_folder(
        spread(table(spark, sf_dir, "images").select("id", "path", "metadata_json", "mtime"), "id"),
        folders,
        "path",
        {"zone_name": "folder_zone"},
    )
    written = entries(images, TIME_NAMES, ["id", "folder_zone"], ["OffsetTimeOriginal", "OffsetTime", "Make"])
    own = (
        F.when(F.col("name") == "DateTimeOriginal", F.col("OffsetTimeOriginal"))
        .when(F.col("name") == "ModifyDate", F.col("OffsetTime"))
        .when(F.col("name") == "GPSDateTime", F.lit("UTC"))
    )
    values = written.select(
        "id",
        "tag",
        F.concat_ws("\t", "tag", "Make").alias("source"),
        F.col("tag").alias("family"),
        "value",
        F.lit(None).cast("double").alias("number"),
        own.alias("own_zone"),
        F.col("folder_zone").alias("local_zone"),
    )
    stamps = images.where(F.col("mtime").isNotNull()).select(
        "id",
        F.lit("mtime").alias("tag"),
        F.lit("mtime").alias("source"),
        F.lit("mtime").alias("family"),
        F.lit(None).cast("string").alias("value"),
        F.col("mtime").alias("number"),
        F.lit(None).cast("string").alias("own_zone"),
        F.lit(None).cast("string").alias("local_zone"),
    )
    return normalise_times(union(values, stamps)).select(
        "id", "tag", "utc_second", "reading", "posterior", "ambiguous"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_times(spark, sf_dir).select("id", "tag", "utc_second")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword and subject value with its position."""
    packed = entries(table(spark, sf_dir, "images"), LIST_NAMES, ["id"]).select(
        "id", "tag", "value", (F.col("name") == "HierarchicalSubject").alias("hierarchical")
    )
    return explode_lists(packed)


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities of the images. The entity is the picture, where several of its entries say the same quantity."""
    images = spread(table(spark, sf_dir, "images").select("id", "metadata_json"), "id")
    measured = entries(images, QUANTITY_NAMES, ["id"], ["ResolutionUnit", "GPSAltitudeRef"], repeated="several")
    return measured.select(
        "id",
        "tag",
        F.col("name").alias("quantity"),
        "value",
        F.col("ResolutionUnit").alias("bare_unit"),
        F.col("GPSAltitudeRef").alias("reference"),
        F.when(F.col("several"), F.col("id")).alias("entity"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quantity of the images in the unit common to its kind."""
    return harmonise(_quantities(spark, sf_dir)).select("id", "tag", "amount")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way of writing a quantity, with its unit, the scale and offset that were estimated, and what decided."""
    return judged_sources(_quantities(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between consecutive snapshots of the pictures' stamps and of the folder registry."""
    images = snapshot_changes(table(spark, sf_dir, "image_snapshots"), "path", ["mtime", "size"])
    registry = table(spark, sf_dir, "folder_snapshots")
    later = registry.columns[registry.columns.index("path") + 1 :]
    folders = snapshot_changes(registry, "path", later)
    columns = ["entity", "snapshot_no", "path", "change_kind"]
    return union(
        images.withColumn("entity", F.lit("image")).select(columns),
        folders.withColumn("entity", F.lit("folder")).select(columns),
    )


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image with the typed columns of tag_types."""
    wide = widen(table(spark, sf_dir, "image_metadata"), table(spark, sf_dir, "tag_types"))
    return wide.select([c for c in wide.columns if not c.endswith("__unreadable")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreadable(widen(table(spark, sf_dir, "image_metadata"), table(spark, sf_dir, "tag_types")))


QUERIES = {
    "p1_found": p1_found,
    "p1_times": p1_times,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_sources": p4_sources,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_wide": p6_wide,
}

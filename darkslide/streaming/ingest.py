"""Scans delivered as files, taken up by Structured Streaming.

A stream sees files that arrive, never files that vanish, so deletions stay with the batch comparison of full scans; a
stream keeps the newest stamp of each path up to date as deliveries come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from darkslide.operators.catalog import Catalog, last_by_path, upsert

DELIVERY = "path string, filename string, mtime double, size bigint, metadata_json string"


def stream_deliveries(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_catalog(deliveries: DataFrame, catalog: Catalog, empty: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the catalogue: one atomic commit per batch, the latest stamp of a path winning. A
    batch that is delivered again after a failure merges to the same rows."""

    def merge(batch: DataFrame, _: int) -> None:
        images = catalog.read("images")
        images = images if images is not None else empty
        latest = last_by_path(batch, [F.col("mtime").desc(), F.col("size").desc(), F.col("metadata_json").desc()])
        catalog.commit(images=upsert(images, latest.withColumn("id", F.lit(None).cast("bigint"))))

    return (
        deliveries.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Parquet tables of a data directory, and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def guard(spark: SparkSession) -> SparkSession:
    """Sets two properties of the session that plans here count on.

    A union of equally partitioned inputs must not count as partitioned itself: in Spark 4.1 adaptive execution may read
    those inputs in different pieces after all; rows with one key then stay apart, and a distinct() over the union was
    seen to keep copies. A union that feeds a join or aggregate is exchanged instead.

    Generated methods over 8,000 bytes are run operator by operator: HotSpot never compiles them, and the parse of times
    took more than half as long again."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of tables with the same columns, in any order of columns."""
    guard(first.sparkSession)
    for df in others:
        first = first.unionByName(df)
    return first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a directory with one Parquet file or folder per table."""
    return guard(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` over all cores by `key`, for work that costs far more than moving its input: a table in fewer pieces than
    there are cores is dealt out anew. Tables in more pieces, and so all large ones, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, as in tests, a session that runs on one machine
    gets a temporary one; on a cluster there must be one that all executors share."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="darkslide-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a table that is written once and read several times."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def copartitioned(df: DataFrame, label: str, key: str, *partition_by: str, exchange: bool = True) -> DataFrame:
    """`df` written to the shared folder in buckets of `key`, sorted by it: tables written so are joined by the key
    without being exchanged. Rows that don't lie by the key yet are exchanged once before that, so that a bucket is one
    file. The session's catalogue gets an entry for it, which only names the folder."""
    spark = df.sparkSession
    path, n = shared_path(spark, label), shuffle_partitions(spark)
    name = os.path.basename(path).replace("-", "_")
    writer = (df.repartition(n, key) if exchange else df).write.format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

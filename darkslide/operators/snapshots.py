"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.sources.tables import shuffle_partitions, written


def in_force(df: DataFrame, key: str, compare: list[str], snapshot: str, delivered: str) -> DataFrame:
    """One row per snapshot and key: of several rows the latest delivered counts; of rows delivered at the same moment
    the one with the greatest values, so that the result doesn't depend on row order. Rows without snapshot or key
    belong to nothing and are left out. The maximum is combined on the map side, so a key that holds a third of all
    rows moves as one row per task."""
    latest = F.max(F.struct(F.col(delivered), *[F.col(c) for c in compare])).alias("__row")
    return (
        df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(snapshot).alias("__no"), F.col(key).alias("__key"))
        .agg(latest)
        .select("__no", "__key", *[F.col(f"__row.{c}").alias(f"__c{i}") for i, c in enumerate(compare)])
    )


def snapshot_changes(
    df: DataFrame,
    key: str,
    compare: list[str],
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
) -> DataFrame:
    """(snapshot_no, <key>, change_kind) of every key that differs from the snapshot delivered before.

    EXCEPT ALL in both directions removes the rows that are the same in two consecutive snapshots; what is left is
    full-joined by key: present only in the later one is `added`, only in the earlier one `removed`, in both `changed`.
    Comparison is exact and two nulls are equal. Snapshots are ordered by number and need not be numbered without
    gaps; the first has no changes. An empty table, or one snapshot, gives no rows. Other columns don't matter.

    Either EXCEPT ALL is a sum over equal rows, of 1 for its first side and -1 for its second; both directions are one sum
    with its two signs, so both are read off one aggregate. The rows in force move twice, once to be found and once to lie
    together by key; each then stands in its own snapshot and against the next one where it lies. A key has one row in force a
    snapshot, so it is no hot group by then. The table of consecutive numbers has a row for each delivery; it is written,
    so that the planner knows its size before it may broadcast it."""
    listed = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(F.col(snapshot).alias("__n")).distinct()
    order = Window.orderBy("__n")
    first = F.lag("__n").over(order).isNull().alias("__first")
    steps = written(listed.select("__n", first, F.lead("__n").over(order).alias("__after")), "steps")
    values = [f"__c{i}" for i in range(len(compare))]
    together = in_force(df, key, compare, snapshot, delivered).repartition(shuffle_partitions(df.sparkSession), "__key")
    sides = F.array(
        F.struct(F.when(~F.col("__first"), F.col("__no")).alias("__at"), F.lit(1).alias("__sign")),
        F.struct(F.col("__after").alias("__at"), F.lit(-1).alias("__sign")),
    )
    placed = together.join(steps, F.col("__no") == F.col("__n")).select("__key", *values, F.inline(sides))
    left = placed.where(F.col("__at").isNotNull()).groupBy("__key", "__at", *values).agg(F.sum("__sign").alias("__left"))
    left = written(left.where("__left <> 0").select("__at", "__key", "__left"), "residues")
    came = left.where("__left > 0").select("__at", "__key", F.lit(True).alias("__came"))
    went = left.where("__left < 0").select("__at", "__key", F.lit(True).alias("__went"))
    kind = F.when(F.col("__went").isNull(), "added").when(F.col("__came").isNull(), "removed").otherwise("changed")
    return came.join(went, ["__at", "__key"], "full").select(
        F.col("__at").alias(snapshot), F.col("__key").alias(key), kind.alias("change_kind")
    )

"""Entity, attribute, value rows into one row per entity with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.sources.tables import copartitioned

INTEGER = r"^[+-]?[0-9]+([.]0*)?$"
DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FRACTION = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)\s*/\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"
DAY = r"^([0-9]{4})([:-])([0-9]{1,2})\2([0-9]{1,2})(?:[ T].*)?$"
BLANKS = r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$"
FAN = 8
TYPES = ("bigint", "double", "boolean", "date", "string")


def read_as(value: Column, kind: str) -> Column:
    """`value` (without outer blanks) read as `kind`; null where it cannot be read.

    bigint: a signed whole number that fits 64 bits, a zero fraction allowed. double: a decimal number with exponent,
    or a fraction whose denominator isn't zero; NaN and infinity are no decimal numbers. boolean: 0, 1, true, false,
    yes, no in any case. date: a real day as Y:M:D or Y-M-D, followed by anything after a blank or T. string: as is."""
    if kind == "bigint":
        whole = F.regexp_extract(value, r"^([+-]?[0-9]+)", 1)
        return F.when(value.rlike(INTEGER), whole.try_cast("bigint"))
    if kind == "double":
        top = F.substring_index(value, "/", 1).try_cast("double")
        bottom = F.substring_index(value, "/", -1).try_cast("double")
        return F.when(value.rlike(DECIMAL), value.try_cast("double")).when(
            value.rlike(FRACTION), F.try_divide(top, bottom)
        )
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin("1", "true", "yes"), F.lit(True)).when(low.isin("0", "false", "no"), F.lit(False))
    if kind == "date":
        ymd = F.regexp_replace(F.regexp_extract(value, r"^([0-9]{4}[:-][0-9]{1,2}[:-][0-9]{1,2})", 1), ":", "-")
        return F.when(value.rlike(DAY), ymd.try_cast("date"))
    if kind == "string":
        return value
    raise ValueError(f"unknown type {kind!r}")


def in_force(df: DataFrame, tag_types: DataFrame, entity: str, tag: str, value: str, recorded: str) -> DataFrame:
    """(entity, column_name, value): the latest recorded value of each column under any of its spellings.

    Null and blank values are passed over, a null time is older than any; of values recorded at the same moment the
    greatest counts. Rows without entity, and tags that aren't listed, belong to nothing. The maximum is combined on
    the map side, so an entity with a third of all rows costs one row per column and task."""
    listed = tag_types.select(F.col("tag").alias("__tag"), F.col("column_name").alias("__column")).distinct()
    clean = F.regexp_replace(F.col(value), BLANKS, "")
    rows = df.select(
        F.col(entity).alias("__entity"), F.col(tag).alias("__t"), clean.alias("__value"), F.col(recorded).alias("__at")
    ).where(F.col("__entity").isNotNull() & (F.col("__value") != ""))
    return (
        rows.join(listed, F.col("__t") == F.col("__tag"))
        .groupBy("__entity", "__column")
        .agg(F.max(F.struct("__at", "__value")).alias("__last"))
        .select("__entity", "__column", F.col("__last.__value").alias("__value"))
    )


def widen(
    df: DataFrame,
    tag_types: DataFrame,
    entity: str = "image_id",
    tag: str = "tag",
    value: str = "tag_value",
    recorded: str = "recorded_at",
) -> DataFrame:
    """One row per entity: for every column of `tag_types` its typed value, and `<column>__unreadable`, true where the
    value in force cannot be read as the column's type, false where it can, null where there is none.

    The rows in force are written to the shared folder once, partitioned by attribute and, within each, by entity; each
    partition is a narrow table that is typed as it is read. A balanced tree of outer joins from the entities to the narrow
    tables combines them, without another exchange. An entity without any value in force gives no row.

    `tag_types` is the registry of columns: it becomes the schema of the result, so it is read by the driver."""
    declared = tag_types.groupBy("column_name").agg(F.min("value_type").alias("value_type")).collect()
    columns = sorted((r["column_name"], r["value_type"]) for r in declared if r["column_name"] is not None)
    rows = in_force(df, tag_types, entity, tag, value, recorded)
    kept = copartitioned(rows, "narrow", "__entity", "__column")
    spine = kept.select("__entity").distinct()

    def narrow(name: str, kind: str) -> DataFrame:
        return kept.where(F.col("__column") == name).select(
            "__entity",
            read_as(F.col("__value"), kind).alias(name),
            read_as(F.col("__value"), kind).isNull().alias(f"{name}__unreadable"),
        )

    wide = outer_join_all(spine, [narrow(*c) for c in columns])
    return wide.withColumnRenamed("__entity", entity)


def outer_join_all(spine: DataFrame, tables: list[DataFrame], fan: int = FAN) -> DataFrame:
    """The entities of `spine` with the columns of all `tables`, each with one row per entity: a balanced tree of outer
    joins over tables that lie by entity already. A node joins at most `fan` tables and is written where it lies, so that
    a task never holds more sorters than that, however many columns there are."""
    while len(tables) > fan:
        nodes = -(-len(tables) // fan)
        size = -(-len(tables) // nodes)
        parts = [tables[i : i + size] for i in range(0, len(tables), size)]
        tables = [copartitioned(outer_join_all(spine, part), "node", "__entity", exchange=False) for part in parts]
    for t in tables:
        spine = spine.join(t, "__entity", "left")
    return spine


def unreadable(wide: DataFrame, entity: str = "image_id") -> DataFrame:
    """(entity, column_name) of the values in a table made by `widen` that couldn't be read as their column's type."""
    names = [c[: -len("__unreadable")] for c in wide.columns if c.endswith("__unreadable")]
    if not names:
        return wide.select(entity, F.lit("").alias("column_name")).limit(0)
    bad = F.array_compact(F.array(*[F.when(F.col(f"{n}__unreadable"), F.lit(n)) for n in names]))
    return wide.select(entity, F.explode(bad).alias("column_name"))

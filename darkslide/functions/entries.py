"""Entries of a JSON object of tags: key as stored, bare name after the last colon, and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_map(json_col: Column) -> Column:
    """The JSON object as map<string,string>. Null, malformed and non-object JSON give null; nested values keep their
    JSON text."""
    return F.from_json(json_col, "map<string,string>")


def tag_name(tag: Column) -> Column:
    """What follows the last colon of a key."""
    return F.substring_index(tag, ":", -1)


def _named(name: str) -> Callable[[Column], Column]:
    return lambda e: tag_name(e["key"]) == name


def entries(
    df: DataFrame,
    names: list[str],
    keep: list[str],
    siblings: list[str] | None = None,
    json_col: str = "metadata_json",
    repeated: str | None = None,
) -> DataFrame:
    """One row per entry whose bare name is in `names`: the columns `keep`, then tag, name and value, and for each of
    `siblings` the value of the first entry of the same object with that bare name, or null; and, if `repeated` names a
    column, whether some bare name has several entries in the object.

    Rows whose value is null give no entry. A cheap substring test keeps rows without any of the names from being
    parsed at all, and siblings are looked up once for an object, before its entries become rows."""
    has_any = F.lit(False)
    for n in names:
        has_any = has_any | F.col(json_col).contains(n)
    parsed = df.where(has_any).select(*keep, F.map_entries(tag_map(F.col(json_col))).alias("__all"))
    wanted = F.filter("__all", lambda e: tag_name(e["key"]).isin(names) & e["value"].isNotNull())
    found = [
        F.get(F.filter("__all", _named(n)), F.lit(0))["value"].alias(n)
        for n in siblings or []
    ]
    if repeated:
        several = F.array_distinct(F.transform(wanted, lambda e: tag_name(e["key"])))
        found.append((F.size(wanted) > F.size(several)).alias(repeated))
    return parsed.select(*keep, *found, F.explode(wanted).alias("__e")).select(
        *keep,
        F.col("__e.key").alias("tag"),
        tag_name(F.col("__e.key")).alias("name"),
        F.col("__e.value").alias("value"),
        *(siblings or []),
        *([repeated] if repeated else []),
    )

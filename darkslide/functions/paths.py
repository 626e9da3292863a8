"""Path functions for paths that use / or \\ and compare exactly, character by character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """The path with every separator written /; same length, used only to find positions."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def depth(path: Column) -> Column:
    """Number of parts between separators."""
    return F.size(F.split(slashed(path), "/"))


def ancestor(path: Column, parts: int) -> Column:
    """The first `parts` parts of the path, as written; null unless something follows them."""
    head = F.length(F.substring_index(slashed(path), "/", parts))
    return F.when(head < F.length(path), F.substring(path, F.lit(1), head))


def with_longest_folder(df: DataFrame, folders: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """`df` with the `fields` (new name by column of `folders`) of the registered folder with the longest path above
    `path`; null where there is none. `folders` has the column path; of several rows with one path the least values
    count.

    One equi-join per depth that occurs in the registry, deepest first: a folder of depth k can only be the first k
    parts of a path. Nothing is exploded or aggregated, so a folder that holds most rows is no hot group; the registry
    is small, and it is for the planner to broadcast it if it is. The driver sees only the distinct depths."""
    bare = F.regexp_replace(F.col("path"), r"[/\\]+$", "")
    aggs = [F.min(F.struct(*[F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(fields)], *fields)).alias("__f")]
    known = folders.where(F.col("path").isNotNull()).groupBy(bare.alias("__folder")).agg(*aggs).where("__folder <> ''")
    depths = sorted((r[0] for r in known.select(depth(F.col("__folder"))).distinct().collect()), reverse=True)
    out, found = df, []
    for k in depths:
        level = known.where(depth(F.col("__folder")) == k).select(
            F.col("__folder").alias(f"__at{k}"), F.col("__f").alias(f"__f{k}")
        )
        out = out.join(level, ancestor(F.col(path), k) == F.col(f"__at{k}"), "left")
        found.append(F.col(f"__f{k}"))
    best = F.coalesce(*found) if found else None
    return out.select(
        *[df[c] for c in df.columns],
        *[(best[c] if found else F.lit(None).cast(dict(folders.dtypes)[c])).alias(n) for c, n in fields.items()],
    )

"""The same quantity recorded in different units and scales, converted to one unit per quantity.

A source is one way of writing a quantity: the quantity and the unit text as spelled, or the unit implied for bare
numbers. Sources are linked through the entities that are written in both: the quantiles of their values over those
entities are pairs of one value each, from which come a robust scale and offset. Where no entities are shared, the
quantiles of all values of two sources stand in for them: the same quantity measured on the same population has the same
quantiles in any unit. The estimates snap to known conversions and propagate from the bare-number source of a quantity
through the graph of sources. How a unit is spelled is a prior that weak evidence can't overrule."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.sources.tables import written

# Unit -> (scale, offset) to the base unit of its dimension: base = scale * value + offset.
LENGTH = {
    "um": (1e-6, 0.0), "mm": (1e-3, 0.0), "cm": (1e-2, 0.0), "m": (1.0, 0.0), "km": (1e3, 0.0), "in": (0.0254, 0.0),
    "ft": (0.3048, 0.0), "yd": (0.9144, 0.0), "mi": (1609.344, 0.0),
}
TIME = {"us": (1e-6, 0.0), "ms": (1e-3, 0.0), "s": (1.0, 0.0), "min": (60.0, 0.0), "h": (3600.0, 0.0)}
TEMPERATURE = {"c": (1.0, 0.0), "k": (1.0, -273.15), "f": (1 / 1.8, -32 / 1.8)}
SIZE = {
    "b": (1.0, 0.0), "kb": (1e3, 0.0), "mb": (1e6, 0.0), "gb": (1e9, 0.0), "tb": (1e12, 0.0), "kib": (2.0**10, 0.0),
    "mib": (2.0**20, 0.0), "gib": (2.0**30, 0.0), "tib": (2.0**40, 0.0),
}
DENSITY = {"dpi": (1.0, 0.0), "dpcm": (2.54, 0.0)}

# Spellings of units, lower case, in each dimension.
SPELLINGS = {
    "length": {
        "um": ["um", "μm", "micrometer", "micrometers", "micrometres", "microns"],
        "mm": ["mm", "millimeter", "millimeters", "millimetre", "millimetres"],
        "cm": ["cm", "centimeter", "centimeters", "centimetre", "centimetres"],
        "m": ["m", "meter", "meters", "metre", "metres"],
        "km": ["km", "kilometer", "kilometers", "kilometre", "kilometres"],
        "in": ["in", "inch", "inches", '"', "″"],
        "ft": ["ft", "foot", "feet", "'", "′"],
        "yd": ["yd", "yard", "yards"],
        "mi": ["mi", "mile", "miles"],
    },
    "time": {
        "us": ["us", "μs", "usec", "microsecond", "microseconds"],
        "ms": ["ms", "msec", "millisecond", "milliseconds"],
        "s": ["s", "sec", "secs", "second", "seconds", '"', "″"],
        "min": ["min", "mins", "minute", "minutes"],
        "h": ["h", "hr", "hour", "hours"],
    },
    "temperature": {
        "c": ["c", "°c", "deg c", "celsius", "degrees c", "℃"],
        "k": ["k", "°k", "deg k", "kelvin"],
        "f": ["f", "°f", "deg f", "fahrenheit", "degrees f", "℉"],
    },
    "size": {
        "b": ["b", "byte", "bytes"],
        "kb": ["kb"],
        "mb": ["mb"],
        "gb": ["gb"],
        "tb": ["tb"],
        "kib": ["kib"],
        "mib": ["mib"],
        "gib": ["gib"],
        "tib": ["tib"],
    },
    "density": {
        "dpi": ["dpi", "ppi", "dots/inch", "pixels/inch", "px/in", "dots/in", "inches", "inch", "2"],
        "dpcm": ["dpcm", "ppcm", "dots/cm", "pixels/cm", "px/cm", "cm", "3"],
    },
}
DIMENSIONS = {
    "length": LENGTH,
    "time": TIME,
    "temperature": TEMPERATURE,
    "size": SIZE,
    "density": DENSITY,
}
# quantity -> (dimension, unit of a bare number, units of the result in one base unit)
QUANTITIES = {
    "FocalLength": ("length", "mm", 1e4),
    "ExposureTime": ("time", "s", 1e6),
    "GPSAltitude": ("length", "m", 10.0),
    "SubjectDistance": ("length", "m", 100.0),
    "CameraTemperature": ("temperature", "c", 10.0),
    "FileSize": ("size", "b", 1.0),
    "XResolution": ("density", "dpi", 1.0),
}
QUANTILES = [i / 10 for i in range(1, 10)]
LEAST_PAIRED = 30  # values a source needs before its quantiles say anything
NEAR = 0.25  # furthest a scale may lie from a known conversion, in logarithms
NEAR_OFFSET = 0.5  # furthest the middle value may be moved by it, in spreads between the outer quantiles
NOISE = 1.5  # a scale estimated from n values is unsure by this over the root of n, in logarithms
PRIOR = 6.0  # nats by which a spelling speaks for its unit
WEAK, STRONG = 4.0, 12.0  # nats that a distance weighs at most, estimated from populations and from shared entities
TIE = 0.7  # nats by which a unit must lead
RARE, SELDOM = {"yd", "mi", "h"}, 2.0  # units that are seldom used for these quantities, and nats against them


def number(text: Column) -> Column:
    """A written number: commas group thousands where every group after the first has three digits and the first
    doesn't begin with 0; a single other comma is a decimal comma. Null for anything else."""
    grouped = text.rlike(r"^[+-]?[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:[.][0-9]*)?$")
    return (
        F.when(~text.contains(","), text)
        .when(grouped, F.replace(text, F.lit(","), F.lit("")))
        .when(~text.contains("."), F.replace(text, F.lit(","), F.lit(".")))
        .try_cast("double")
    )


def measured(df: DataFrame) -> DataFrame:
    """`df` plus x, the number as written, inches added to feet as a fraction, and unit, the rest in lower case. The
    generators keep the optimiser from copying the parse into every condition on it."""
    clean = F.translate(F.regexp_replace(F.col("value"), r"^[\s\u00a0|]+|[\s\u00a0]+$", ""), "−µ", "-μ")
    # One pass of each pattern rewrites a value to top|bottom|inches|unit; a value that neither fits has no bar.
    both = r"""^([+-]?[0-9]+(?:[.][0-9]+)?)\s*(?:'|′|ft|feet)\s*([0-9]+(?:[.][0-9]+)?)\s*(?:"|″|in|inches)$"""
    one = r"^([+-]?(?:[0-9][0-9.,]*|[.][0-9]+))\s*(?:/\s*([0-9]+(?:[.][0-9]+)?))?\s*([^0-9|]*)$"
    form = F.regexp_replace(F.regexp_replace(clean, both, "$1||$2|ft"), one, "$1|$2||$3")
    part = F.col("__p")
    rest = F.lower(F.trim(part[3]))
    below = rest.endswith("below sea level")
    unit = F.regexp_replace(F.when(rest.endswith(" sea level"), F.regexp_replace(rest, r"\s*(above|below) sea level$", ""))
                            .otherwise(rest), "[.]$", "")
    ratio = F.when(part[1] == "", number(part[0])).otherwise(F.try_divide(number(part[0]), part[1].try_cast("double")))
    inches = F.when(part[2] == "", 0.0).otherwise(part[2].try_cast("double") / 12)
    made = F.struct((ratio + inches).alias("x"), unit.alias("unit"), below.alias("__below"))
    parts = F.split(form, r"\|")
    return (
        df.select("*", F.explode(F.array(F.when(form.contains("|"), parts))).alias("__p"))
        .select(*df.columns, F.explode(F.array(made)).alias("__m"))
        .select(*df.columns, "__m.*")
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
    )


def fit(a: list[float], b: list[float]) -> tuple[float, float] | None:
    """Robust scale and offset with b = scale * a + offset, from paired quantiles: the medians of the slopes between
    pairs and of what they leave."""
    slopes = sorted(
        (b[j] - b[i]) / (a[j] - a[i]) for i in range(len(a)) for j in range(i + 1, len(a)) if a[j] > a[i]
    )
    if not slopes or slopes[len(slopes) // 2] <= 0:
        return None
    scale = slopes[len(slopes) // 2]
    left = sorted(y - scale * x for x, y in zip(a, b, strict=True))
    return scale, left[len(left) // 2]


@dataclass
class Verdict:
    """The unit of a source, the scale and offset to the base unit that were estimated (None where nothing was), from how
    many values, and what decided: bare number, spelling, estimate, both, or estimate against spelling."""

    unit: str | None
    scale: float | None = None
    offset: float | None = None
    n: int = 0
    by: str = ""


def distances(dimension: str, scale: float, offset: float, quantiles: list[float], n: int) -> dict[str, float]:
    """For each unit whose conversion lies near an estimated line, how unlikely the distance is, in nats. Scales are
    compared in logarithms, in units of what n values leave uncertain. Offsets are compared by how far the two conversions
    move the middle value apart, in spreads of the converted values: where the line crosses zero says little about values
    far from there."""
    middle, spread = quantiles[len(quantiles) // 2], scale * (quantiles[-1] - quantiles[0])
    unsure = NOISE / math.sqrt(n)
    out = {}
    for unit, (a, b) in DIMENSIONS[dimension].items():
        by_scale, by_offset = abs(math.log(a / scale)), abs(a * middle + b - scale * middle - offset) / spread
        if by_scale <= NEAR and by_offset <= NEAR_OFFSET:
            out[unit] = ((by_scale / unsure) ** 2 + (by_offset / unsure) ** 2) / 2 + (SELDOM if unit in RARE else 0.0)
    return out


def snap(found: dict[str, float], spelled: str | None, most: float) -> str | None:
    """The unit with the least distance, or None if none is near or two are about as near. The spelled unit starts with
    an advantage, and no distance weighs more than `most`."""
    away = {u: min(d, most) - (PRIOR if u == spelled else 0.0) for u, d in found.items()}
    if spelled:
        away.setdefault(spelled, most - PRIOR)
    ranked = sorted(away, key=lambda u: (away[u], u))
    if not ranked or len(ranked) > 1 and away[ranked[1]] - away[ranked[0]] < TIE:
        return None
    return ranked[0]


def judge(
    stats: list[tuple[str, str, int, list[float]]],
    links: list[tuple[str, str, str, int, list[float], list[float]]] = (),
) -> dict[tuple[str, str], Verdict]:
    """The verdict on each source (quantity, spelling), from (quantity, source, values, quantiles) of all sources and
    (quantity, source, other, entities, quantiles of source, quantiles of other) of those that share entities.

    The sources of a quantity are a graph. Starting from the bare-number source, whose unit is given, or else from the most
    common spelling that is known, the best-supported edge to a source without a verdict is followed: edges of shared
    entities before those of populations, each by its smaller number of values. The line along the edge is put before the
    known conversion of the source it comes from, so that errors don't add up. A source with too few values has only its
    spelling, and one that neither spelling nor estimate explains stays unresolved."""
    out: dict[tuple[str, str], Verdict] = {}
    for quantity, (dimension, bare, _) in QUANTITIES.items():
        spelled = {w: u for u, ws in SPELLINGS[dimension].items() for w in ws}
        nodes = {unit: (n, q) for name, unit, n, q in stats if name == quantity}
        known = {u: spelled[u] for u in nodes if u in spelled}
        enough = {u for u in nodes if nodes[u][0] >= LEAST_PAIRED}
        start = "" if "" in nodes else max(known, key=lambda u: (nodes[u][0], u), default=None)
        if start is None:
            continue
        out[quantity, start] = Verdict(bare if start == "" else known[start], n=nodes[start][0], by="bare number" if start == "" else "spelling")
        edges = [(True, n, a, b, qa, qb) for name, a, b, n, qa, qb in links if name == quantity and n >= LEAST_PAIRED]
        edges += [(True, n, b, a, qb, qa) for _, n, a, b, qa, qb in list(edges)]
        edges += [
            (False, min(nodes[a][0], nodes[b][0]), a, b, nodes[a][1], nodes[b][1])
            for a in enough for b in enough if a != b
        ]
        edges.sort(key=lambda e: (e[0], e[1], e[2], e[3]), reverse=True)
        while True:
            open_ = [e for e in edges if (quantity, e[2]) not in out and (quantity, e[3]) in out and out[quantity, e[3]].unit]
            if not open_:
                break
            shared, n, a, b, qa, qb = open_[0]
            line = fit(qa, qb)
            if line is None:
                edges.remove(open_[0])
                continue
            known_scale, known_offset = DIMENSIONS[dimension][out[quantity, b].unit]
            scale, offset = known_scale * line[0], known_scale * line[1] + known_offset
            found = distances(dimension, scale, offset, qa, n)
            unit = snap(found, known.get(a), STRONG if shared else WEAK)
            by = "estimate" if a not in known else "both" if unit in found and unit == known[a] else "spelling"
            if unit and a in known and unit != known[a]:
                by = "estimate against spelling"
            out[quantity, a] = Verdict(unit, scale, offset, n, by if unit else "")
        for unit in known:
            out.setdefault((quantity, unit), Verdict(known[unit], n=nodes[unit][0], by="spelling"))
    return out


def resolve(stats: list, links: list = ()) -> dict[tuple[str, str], str]:
    """The unit of each source that has one."""
    return {k: v.unit for k, v in judge(stats, links).items() if v.unit}


def source_statistics(values: DataFrame) -> list[tuple[str, str, int, list[float]]]:
    """(quantity, unit, count, quantiles) of every source: one small row for each spelling, however many values."""
    rows = (
        values.groupBy("quantity", "source")
        .agg(F.count("*").alias("n"), F.percentile_approx("x", QUANTILES, 1000).alias("q"))
        .collect()
    )
    return [(r["quantity"], r["source"], r["n"], list(r["q"])) for r in rows]


def shared_entities(values: DataFrame) -> list[tuple[str, str, str, int, list[float], list[float]]]:
    """(quantity, source, other, entities, quantiles of source, quantiles of other) of each two sources of a quantity in
    which the same entities are written. An entity counts with its least value in each source. It is paired from its
    first source to each other one, so its rows grow with its sources; a hot entity is one row per source by then."""
    one = values.where("entity is not null").groupBy("entity", "quantity", "source").agg(F.min("x").alias("x"))
    by_entity = one.groupBy("entity", "quantity").agg(F.min(F.struct("source", "x")).alias("first"))
    pairs = one.join(by_entity, ["entity", "quantity"]).where(F.col("source") != F.col("first.source"))
    rows = (
        pairs.groupBy("quantity", F.col("first.source").alias("a"), F.col("source").alias("b"))
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("first.x", QUANTILES, 1000).alias("qa"),
            F.percentile_approx("x", QUANTILES, 1000).alias("qb"),
        )
        .collect()
    )
    return [(r["quantity"], r["a"], r["b"], r["n"], list(r["qa"]), list(r["qb"])) for r in rows]


def _parsed(df: DataFrame) -> DataFrame:
    """The values of `df` with x and source, kept in the shared folder."""
    entity = F.col("entity").cast("string") if "entity" in df.columns else F.lit(None).cast("string")
    df = df.select(F.struct("*").alias("__in"), "quantity", "value", "bare_unit", "reference", entity.alias("entity"))
    bare = F.lower(F.trim("bare_unit"))
    density = F.col("quantity") == "XResolution"
    implied = F.when(density & (F.col("unit") == ""), F.coalesce(bare, F.lit(""))).otherwise(F.col("unit"))
    values = measured(df.where(F.col("quantity").isin(list(QUANTITIES)))).withColumn("source", implied)
    return written(values.drop("value"), "values")


def judged_sources(df: DataFrame) -> DataFrame:
    """(quantity, source, n, unit, scale, offset, decided_by): the verdict on every way of writing a quantity, with the
    scale and offset to the base unit of its dimension that were estimated from n values."""
    values = _parsed(df)
    verdicts = judge(source_statistics(values), shared_entities(values))
    rows = [(q, s, v.n, v.unit, v.scale, v.offset, v.by) for (q, s), v in sorted(verdicts.items())]
    kind = "quantity string, source string, n bigint, unit string, scale double, offset double, decided_by string"
    return df.sparkSession.createDataFrame(rows, kind)


def harmonise(df: DataFrame) -> DataFrame:
    """`df` plus amount, in the unit common to its quantity, for each row whose value holds a number.

    Columns used: quantity (a key of QUANTITIES), value, bare_unit (what says the unit of a bare number where the
    quantity allows it, or null), reference (1 or Below Sea Level for a height below zero) and, if there is one, entity
    (rows of one entity and quantity say the same; null says nothing). Values without number,
    with a zero denominator, of an unknown quantity or in a unit that stays unresolved give no row; so do nulls.
    Amounts are rounded to the nearest whole number, halves away from zero. A column of `df` named amount is replaced;
    other columns stay, whatever their names.

    Values are parsed once and kept in the shared folder. The statistics are one pass with partial aggregation; the driver gets one row for each quantity and spelling, and
    conversions come back as a literal map, so the second pass is a projection without any shuffle."""
    given = df
    values = _parsed(df)
    units = resolve(source_statistics(values), shared_entities(values))
    if not units:
        return given.withColumn("amount", F.lit(None).cast("bigint")).limit(0)
    scale, offset = [], []
    for (quantity, source), unit in sorted(units.items()):
        dimension, _, per_base = QUANTITIES[quantity]
        a, b = DIMENSIONS[dimension][unit]
        key = F.lit(f"{quantity}\t{source}")
        scale += [key, F.lit(a * per_base)]
        offset += [key, F.lit(b * per_base)]
    key = F.concat_ws("\t", "quantity", "source")
    below = F.col("__below") | (
        (F.col("quantity") == "GPSAltitude") & F.lower(F.trim("reference")).isin("1", "below sea level")
    )
    exact = F.col("x") * F.try_element_at(F.create_map(*scale), key) + F.try_element_at(F.create_map(*offset), key)
    signed = F.when(F.coalesce(below, F.lit(False)), -F.abs(exact)).otherwise(exact)
    return (
        values.withColumn("amount", F.round(F.round(signed, 6), 0).try_cast("bigint"))
        .where(F.col("amount").isNotNull())
        .select(*[F.col("__in")[c].alias(c) for c in given.columns if c != "amount"], "amount")
    )

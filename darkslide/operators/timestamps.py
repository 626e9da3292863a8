"""Times written in many formats, precisions and zones, brought to seconds since 1970 in UTC.

Every value is read under each format that fits it. Where more than one reading is possible, a mixture of formats per
source is fitted by expectation-maximisation over all values of the source, and the posterior chooses; so do the meanings
of zone abbreviations. A posterior below `CLEAR` marks the value as ambiguous, as does a local time that occurs twice or
not at all."""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.sources.tables import written

# Hours east of UTC of common zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3,
    "MSK": 3, "IST": 5.5, "NPT": 5.75, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10,
    "AEDT": 11, "LHST": 10.5, "LHDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8,
    "HST": -10,
}
# Abbreviations with several meanings, the usual one first, in hours.
MEANINGS = {"IST": [5.5, 1, 2], "BST": [1, 6], "CST": [-6, 8], "AST": [-4, 3], "EST": [-5, 10], "EDT": [-4, 11]}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Readings that can compete: calendar orders of numeric dates, and (units in a second, seconds from 1970 to the origin).
ORDERS = ["dmy", "mdy"]
COUNTS = {
    "s1970": (1.0, 0),
    "ms1970": (1e3, 0),
    "us1970": (1e6, 0),
    "ns1970": (1e9, 0),
    "100ns1601": (1e7, -11644473600),
    "s2001": (1.0, 978307200),
    "s1904": (1.0, -2082844800),
    "days1899": (1 / 86400, -2209161600),
}
READINGS = [*ORDERS, *COUNTS]
LEAST_COUNT, LARGEST_COUNT = 1e6, 1e12
EARLIEST, LATEST = 631152000, 2208988800  # a count names an instant from 1990 to 2040
CLEAR = 0.95
USUAL = 20.0  # values of its kind that the usual meaning of an abbreviation is worth before any is seen
UNSUPPORTED = 0.1  # likelihood of a meaning that another one's agreement with the folder's zone speaks against
FAMILY = 20.0  # values of a source that the mixture of its family is worth
RESULTS = ["utc_second", "reading", "posterior", "ambiguous"]

ZONE = r"(Z|[A-Z]{2,5}|[+\-−][0-9]{2}(?::?[0-9]{2})?|\[[A-Za-z0-9_+\-/]+\]|[A-Za-z]+/[A-Za-z0-9_+\-/]+)?"
# Each pattern with its replacement: year|month|day|hour|minute|second|am or pm|zone|family.
FORMATS = [
    (rf"^([0-9]{{4}})[:\-]([0-9]{{1,2}})[:\-]([0-9]{{1,2}})[ T]+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,][0-9]*)?)?\s*{ZONE}$", "$1|$2|$3|$4|$5|$6||$7|ymd"),
    (rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})?(?:[.,][0-9]*)?\s*{ZONE}$", "$1|$2|$3|$4|$5|$6||$7|ymd"),
    (rf"^([0-9]{{1,2}})[./]([0-9]{{1,2}})[./]([0-9]{{4}})[ T]+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,][0-9]*)?)?\s*{ZONE}$", "$3|$2|$1|$4|$5|$6||$7|numeric"),
    (rf"^(?:[A-Za-z]{{3,9}},? +)?([0-9]{{1,2}}) ([A-Za-z]{{3,9}}) ([0-9]{{4}}) ([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\s*{ZONE}$", "$3|$2|$1|$4|$5|$6||$7|named"),
    (rf"^([A-Za-z]{{3,9}}) ([0-9]{{1,2}}),? ([0-9]{{4}}),? ([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\s*([AaPp])[Mm]\s*{ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|named"),
    (r"^[A-Za-z]{3} ([A-Za-z]{3}) +([0-9]{1,2}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([0-9]{4})$", "$6|$1|$2|$3|$4|$5|||named"),
]
COUNT = r"^[0-9]{5,19}(?:[.][0-9]+)?$"


PARTS = "year int, month string, day int, hour int, minute int, second int, half string, zone string, family string"


def _number(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def fields(value: Column) -> Column:
    """The parts of a written time as a struct, all null if it has no known form.

    Each pattern rewrites the values it fits to one line of parts, which no other pattern fits."""
    form = F.regexp_replace(value, r"^[\s\u00a0|]+|[\s\u00a0]+$", "")
    for pattern, parts in FORMATS:
        form = F.regexp_replace(form, pattern, parts)
    return F.from_csv(F.when(form.contains("|"), form), PARTS, {"sep": "|"})


def clock_seconds(hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since midnight; null for an impossible clock."""
    real = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(real, hour * 3600 + minute * 60 + second)


def local_seconds(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """Seconds from 1970 to a calendar time read as UTC; null if there is no such time."""
    dash = F.lit("-")
    text = F.concat(year.cast("string"), dash, month.cast("string"), dash, day.cast("string"))
    days = F.date_diff(F.when(year.between(1800, 2199), text).try_cast("date"), F.lit("1970-01-01").cast("date"))
    return days.cast("long") * 86400 + clock


OFFSET = r"^[+\-][0-9]{2}(?:[0-9]{2})?$"


def plain_zone(zone: Column) -> Column:
    """A written zone without brackets, colons and blanks, or null if it is no known offset, abbreviation or region."""
    clean = F.translate(F.trim(zone), "−:[]", "-")
    names = [*ABBREVIATIONS, *(z for z in zoneinfo.available_timezones() if z not in ABBREVIATIONS)]
    return F.when(clean.isin(sorted(names)) | clean.rlike(OFFSET), clean)


def offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of a plain offset or abbreviation; null for a region."""
    pairs = [F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, int(v * 3600))]
    seconds = _number(F.substring(zone, 2, 2)) * 3600 + F.coalesce(_number(F.substring(zone, 4, 2)), F.lit(0)) * 60
    return F.when(zone.startswith("-"), -seconds).when(zone.startswith("+"), seconds).otherwise(
        F.try_element_at(F.create_map(*pairs), zone)
    )


def to_utc(local: Column, zone: Column) -> Column:
    """The instant of a local time in an IANA zone: the first of two, and a skipped one with the offset before. It is
    built without a session's own zone."""
    day, clock = F.floor(local / 86400).cast("int"), F.pmod(local, F.lit(86400)).cast("decimal(18,6)")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.convert_timezone(zone, F.lit("UTC"), origin + F.make_dt_interval(day, F.lit(0), F.lit(0), clock))
    days = F.date_diff(utc.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)


def count_readings(value: Column) -> list[Column]:
    """For each entry of COUNTS, the instant a number counts, or null if that lies outside the plausible years. Nothing
    counts from less than a few days after an origin: that is a clock that was never set."""
    out = []
    for unit, origin in COUNTS.values():
        seconds = value / unit
        at = F.floor(F.when(seconds.between(LEAST_COUNT, LARGEST_COUNT), seconds)).cast("long") + origin
        out.append(F.when(at.between(EARLIEST, LATEST), at))
    return out


def read_times(df: DataFrame) -> DataFrame:
    """`df` (with source, value string, number double) plus `readings`: for each of READINGS, the local second or, for
    counts, the instant, null where impossible; `fixed`, the local second of unambiguous forms; and `written_zone`."""
    f = {c.split()[0]: F.col("__f")[c.split()[0]] for c in PARTS.split(", ")}
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(f["month"], 1, 3))).cast("int")
    half = F.when(F.length(f["half"]) > 0, F.when(
        f["hour"].between(1, 12), F.pmod(f["hour"], F.lit(12)) + F.when(F.lower(f["half"]) == "p", 12).otherwise(0)
    )).otherwise(f["hour"])
    text = F.trim("value")
    out = (
        df.withColumn("__f", fields(F.col("value")))
        .withColumn("__month", F.when(f["family"] == "named", named).otherwise(f["month"].try_cast("int")))
        .withColumn("__clock", clock_seconds(half, f["minute"], F.coalesce(f["second"], F.lit(0))))
        .withColumn("written_zone", F.when(F.length(f["zone"]) > 0, f["zone"]))
        .withColumn("__family", f["family"])
        .withColumn("__usual", local_seconds(f["year"], F.col("__month"), f["day"], F.col("__clock")))
        .withColumn(
            "__swapped",
            F.when(f["family"] == "numeric", local_seconds(f["year"], f["day"], F.col("__month"), F.col("__clock"))),
        )
        .withColumn("__number", F.coalesce(F.col("number"), F.when(text.rlike(COUNT), text.try_cast("double"))))
    )
    numeric = F.coalesce(F.col("__family"), F.lit("")) == "numeric"
    first = F.when(numeric, F.col("__usual"))
    return (
        out.withColumn("readings", F.array(first, F.col("__swapped"), *count_readings(F.col("__number"))))
        .withColumn("fixed", F.when(~numeric, F.col("__usual")))
        .drop(*[c for c in out.columns if c.startswith("__") and c not in df.columns])
    )


def possible(readings: Column) -> Column:
    """Bits of the readings that are possible."""
    bits = F.lit(0)
    for i in range(len(READINGS)):
        bits = bits + F.when(F.get(readings, F.lit(i)).isNotNull(), 1 << i).otherwise(0)
    return bits


def _weights(fits: np.ndarray, weight: np.ndarray, prior: np.ndarray, rounds: int) -> np.ndarray:
    """Shares of the readings by expectation-maximisation: `fits` is the likelihood of each reading of each row."""
    share = prior / prior.sum()
    for _ in range(rounds):
        joint = fits * share
        posterior = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        share = (posterior * weight[:, None]).sum(0) + prior
        share /= share.sum()
    return share


def fit_mixture(counts: pd.DataFrame, rounds: int = 60) -> pd.DataFrame:
    """The format mixtures of the sources of one family: `counts` has the source, its possible readings (mask, as bits) and
    how many values have them.

    A value contributes its likelihood under each possible reading; all instants of the plausible years are equally
    likely within a format, so the likelihood is 1 or 0 and the mixture weights decide. A weak prior keeps a format
    that nothing supports from vanishing at once, so two formats with equal support end with equal posteriors. The mixture
    of all sources of the family is the prior of each, so a source with few values follows the others and one with many
    its own."""
    masks = counts["mask"].to_numpy()
    weight = counts["n"].to_numpy(dtype=float)
    fits = ((masks[:, None] >> np.arange(len(READINGS))) & 1).astype(float)
    whole = _weights(fits, weight, np.full(len(READINGS), 1e-3), rounds)
    best, posterior = np.zeros(len(masks), "int32"), np.zeros(len(masks))
    for mine in counts.reset_index(drop=True).groupby("source", dropna=False).groups.values():
        at = np.asarray(mine)
        share = _weights(fits[at], weight[at], FAMILY * whole + 1e-3, rounds) if len(at) < len(masks) else whole
        joint = fits[at] * share
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-300)
        best[at], posterior[at] = joint.argmax(1), joint.max(1)
    return pd.DataFrame({"source": counts["source"], "mask": masks, "reading": best, "posterior": posterior})


def fit_meanings(counts: pd.DataFrame, rounds: int = 60) -> pd.DataFrame:
    """The meanings of one abbreviation in the sources of one family: `counts` has source, word, support (which meaning
    agrees with the zone of the value's folder, or -1) and n. Where a meaning agrees with the folder the others are
    unlikely; elsewhere the mixture decides, in which the usual meaning starts ahead."""
    meanings = MEANINGS[counts["word"].iloc[0]]
    support, weight = counts["support"].to_numpy(), counts["n"].to_numpy(dtype=float)
    fits = np.ones((len(counts), len(meanings)))
    for k in range(len(meanings)):
        fits[(support >= 0) & (support != k), k] = UNSUPPORTED
    prior = np.ones(len(meanings))
    prior[0] = USUAL
    joint = fits * _weights(fits, weight, prior, rounds)
    joint /= joint.sum(1, keepdims=True)
    best = joint.argmax(1)
    return pd.DataFrame({
        "source": counts["source"], "word": counts["word"], "support": support,
        "seconds": np.array([int(meanings[b] * 3600) for b in best], "int32"), "sure": joint.max(1),
    })


def _at_change(local: Column, utc: Column, zone: Column) -> Column:
    """Whether a local time is skipped, or occurs again within two hours. Clocks are changed at night."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def clock(seconds: Column) -> Column:
        day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)")
        shown = F.convert_timezone(F.lit("UTC"), zone, origin + F.make_dt_interval(day, F.lit(0), F.lit(0), rest))
        days = F.date_diff(shown.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86400 + F.hour(shown) * 3600 + F.minute(shown) * 60 + F.second(shown)

    again = F.lit(False)
    for later in (1800, 3600, 7200):
        again = again | (clock(utc + later) == local)
    hour = F.floor(F.pmod(local, F.lit(86400)) / 3600)
    return F.when((hour <= 4) | (hour == 23), again | (clock(utc) != local)).otherwise(F.lit(False))


def normalise_times(df: DataFrame) -> DataFrame:
    """`df` plus utc_second, reading, posterior and ambiguous, for the rows whose value names an instant.

    Columns used: source (what shares one mixture of formats), family if there is one (the sources that are a prior for
    each other; without it there is one), value (string, or null) or number (double, or null), own_zone (a zone for values
    without one: offset, abbreviation or IANA name, or null) and local_zone (likewise, used where own_zone is null or
    unreadable). Without any zone a time is taken as UTC and marked ambiguous; of a local time that occurs twice the first
    is taken, a skipped one is read with the offset before, and both are marked. Empty, partial, impossible and
    placeholder values give no row, nulls neither. A column of `df` named like a result is replaced.

    The fits read one pre-aggregated row per source and set of possible readings, however common a source is, and are
    written, so that the planner knows how small they are; values with a single possible reading never wait for them."""
    # Other columns travel in one struct, so that their names can't clash.
    given = df
    family = F.col("family") if "family" in df.columns else F.lit(None).cast("string")
    df = given.select(F.struct("*").alias("__in"), "source", family.alias("__family"), "value", "number", "own_zone", "local_zone")
    parsed = read_times(df).withColumn("mask", possible(F.col("readings")))
    # The generator keeps the optimiser from copying the whole parse into the filter. The parse runs twice, for the fit
    # and for the result: keeping it in between was measured to cost as much and three times the disk.
    zone = F.coalesce(*[plain_zone(F.col(c)) for c in ("written_zone", "own_zone", "local_zone")])
    made = F.struct("readings", "fixed", "written_zone", "mask", zone.alias("__zone"))
    read = parsed.select(*df.columns, F.explode(F.array(made)).alias("__r")).select(*df.columns, "__r.*")
    read = read.where(F.col("fixed").isNotNull() | (F.col("mask") > 0))
    # An abbreviation with several meanings, and which of them agrees with the folder's zone at that time of the year.
    written_word = F.trim("written_zone")
    word = F.when(F.col("fixed").isNotNull() & written_word.isin(sorted(MEANINGS)), written_word)
    region = F.when(word.isNotNull() & F.col("local_zone").contains("/"), plain_zone(F.col("local_zone")))
    there = F.col("fixed") - to_utc(F.col("fixed"), region)
    of_word = F.create_map(*[x for w, hours in MEANINGS.items() for x in (F.lit(w), F.array(*[F.lit(int(h * 3600)) for h in hours]))])
    agrees = F.coalesce(F.array_position(F.try_element_at(of_word, word), there.cast("int")) - 1, F.lit(-1)).cast("int")
    read = read.withColumns({"__word": word, "__support": F.when(word.isNotNull(), agrees)})
    groups = ["source", "__family", "mask", "__word", "__support"]
    counts = read.where((F.col("mask") > 0) | F.col("__word").isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"))
    counts = written(counts, "readings")
    chosen = counts.where("mask > 0").groupBy("__family", "source", "mask").agg(F.sum("n").alias("n"))
    chosen = chosen.groupBy("__family").applyInPandas(
        lambda rows: fit_mixture(rows), "source string, mask int, reading int, posterior double"
    )
    chosen = written(chosen.withColumnsRenamed({"source": "__source", "mask": "__mask"}), "mixtures")
    words = counts.where("__word is not null").groupBy("__family", "source", F.col("__word").alias("word"), F.col("__support").alias("support"))
    meant = words.agg(F.sum("n").alias("n")).groupBy("__family", "word").applyInPandas(
        lambda rows: fit_meanings(rows), "source string, word string, support int, seconds int, sure double"
    )
    meant = written(meant.withColumnRenamed("source", "__by"), "meanings")
    joined = read.join(
        chosen, F.col("source").eqNullSafe(F.col("__source")) & (F.col("mask") == F.col("__mask")), "left"
    ).join(
        meant,
        F.col("source").eqNullSafe(F.col("__by")) & (F.col("__word") == F.col("word")) & (F.col("__support") == F.col("support")),
        "left",
    )
    placed = (
        joined.withColumn("__local", F.coalesce(F.col("fixed"), F.get("readings", F.col("reading"))))
        .withColumn("__counted", F.col("fixed").isNull() & (F.col("reading") >= len(ORDERS)))
        .withColumn("__zone", F.when(~F.col("__counted"), F.col("__zone")))
        .withColumn("__offset", F.coalesce(F.col("seconds"), offset_seconds(F.col("__zone"))))
    )
    local, offset = F.col("__local"), F.col("__offset")
    instant = (
        F.when(F.col("__zone").isNull(), local)
        .when(offset.isNotNull(), local - offset)
        .otherwise(to_utc(local, F.col("__zone")))
    )
    unzoned = ~F.col("__counted") & F.col("__zone").isNull()
    names = F.array(*[F.lit(r) for r in READINGS])
    format_sure = F.when(F.col("fixed").isNotNull(), 1.0).otherwise(F.col("posterior"))
    # Another generator, so that what is made here is made once, and not for each thing that is read off it.
    made = F.struct(
        instant.cast("bigint").alias("__utc"), local.alias("__at"), F.when(offset.isNull(), F.col("__zone")).alias("__region"),
        unzoned.alias("__unzoned"), (format_sure * F.coalesce("sure", F.lit(1.0))).alias("__sure"),
    )
    done = placed.select("__in", "fixed", "reading", F.explode(F.array(made)).alias("__d")).select("__in", "fixed", "reading", "__d.*")
    changing = F.when(F.col("__region").isNotNull(), _at_change(F.col("__at"), F.col("__utc"), F.col("__region")))
    sure = F.col("__sure") * F.when(F.coalesce(changing, F.lit(False)), 0.5).otherwise(1.0)
    unzoned = F.col("__unzoned")
    return done.select(
        *[F.col("__in")[c].alias(c) for c in given.columns if c not in RESULTS],
        F.col("__utc").alias("utc_second"),
        F.when(F.col("fixed").isNotNull(), "written").otherwise(F.get(names, F.col("reading"))).alias("reading"),
        sure.alias("posterior"),
        F.coalesce(unzoned | (sure < CLEAR), F.lit(False)).alias("ambiguous"),
    )

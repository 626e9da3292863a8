import random

import pytest

from darkslide.operators import units
from darkslide.operators.units import DIMENSIONS, fit, harmonise, judge, resolve

COLUMNS = "quantity string, value string, bare_unit string, reference string"
CASES = [
    ("FocalLength", "253", None, None, 2530),
    ("FocalLength", "0,014 m", None, None, 140),
    ("FocalLength", '12"', None, None, 3048),
    ("FocalLength", "1350/10", None, None, 1350),
    ("FocalLength", "400000 µm", None, None, 4000),
    ("ExposureTime", "1/60", None, None, 16667),
    ("ExposureTime", '4"', None, None, 4000000),
    ("ExposureTime", "1/250 sec.", None, None, 4000),
    ("ExposureTime", "1.5 min", None, None, 90000000),
    ("GPSAltitude", "12,967.19'", None, None, 39524),
    ("GPSAltitude", "146.9 m Below Sea Level", None, None, -1469),
    ("GPSAltitude", "146.9 m Above Sea Level", None, "0", 1469),
    ("GPSAltitude", "100", None, "1", -1000),
    ("GPSAltitude", "-100", None, "Below Sea Level", -1000),
    ("SubjectDistance", "22' 6\"", None, None, 686),
    ("SubjectDistance", "50 ft 9 in", None, None, 1547),
    ("SubjectDistance", "0,59 m", None, None, 59),
    ("CameraTemperature", "260.25 K", None, None, -129),
    ("CameraTemperature", "-0.22 deg F", None, None, -179),
    ("CameraTemperature", "-8,6 C", None, None, -86),
    ("FileSize", "9,369,496 bytes", None, None, 9369496),
    ("FileSize", "27.75 MiB", None, None, 29097984),
    ("FileSize", "0.16 GB", None, None, 160000000),
    ("XResolution", "944.8819", "3", None, 2400),
    ("XResolution", "944.8819", "cm", None, 2400),
    ("XResolution", "300", "2", None, 300),
    ("XResolution", "59.06 px/cm", "2", None, 150),
]
NOTHING = ["", "  ", None, "n/a", "inf", "infinity", "undef", "1/0", "9.9.9", "m", "x" * 5000, "1 furlong"]


def test_amounts(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "n int, " + COLUMNS)
    got = {r["n"]: r["amount"] for r in harmonise(df).collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}


def test_no_number(spark):
    rows = [("SubjectDistance", v, None, None) for v in NOTHING] + [("Weight", "3 kg", None, None), (None, "3", None, None)]
    assert harmonise(spark.createDataFrame(rows, COLUMNS)).count() == 0
    assert harmonise(spark.createDataFrame([], COLUMNS)).count() == 0


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([("FileSize", "3 kB", None, None, "kept")], COLUMNS + ", scale string")
    assert harmonise(df).first()["scale"] == "kept"


def test_robust_line():
    a = [float(x) for x in range(1, 10)]
    scale, offset = fit(a, [1.8 * x + 32 for x in a])
    assert scale == pytest.approx(1.8) and offset == pytest.approx(32)
    assert fit([1.0, 1.0], [2.0, 3.0]) is None


def test_unknown_spelling_snaps_to_a_known_conversion():
    quantiles = [10.0 * i for i in range(1, 10)]
    stats = [
        ("FocalLength", "", 500, quantiles),
        ("FocalLength", "zolls", 500, [q / 25.2 for q in quantiles]),
        ("FocalLength", "odd", 500, [q * 50 for q in quantiles]),
        ("FocalLength", "rare", 3, [q / 10 for q in quantiles]),
    ]
    found = resolve(stats)
    assert found["FocalLength", ""] == "mm" and found["FocalLength", "zolls"] == "in"
    assert ("FocalLength", "odd") not in found and ("FocalLength", "rare") not in found


def test_unknown_spelling_in_data(spark):
    rows = [("FocalLength", f"{x}", None, None) for x in range(20, 620, 3)]
    rows += [("FocalLength", f"{x / 10} Zenti", None, None) for x in range(20, 620, 3)]
    got = harmonise(spark.createDataFrame(rows, COLUMNS)).where("value = '50.0 Zenti'").first()
    assert got["amount"] == 5000


def quantiles(to_unit, shift=0.0):
    return [to_unit(c + shift) for c in (-12.0, -5.0, 0.0, 5.0, 11.0, 16.0, 21.0, 27.0, 34.0)]


TO = {"c": lambda c: c, "k": lambda c: c + 273.15, "f": lambda c: 1.8 * c + 32}


@pytest.mark.parametrize("known", ["", "k", "f"])
@pytest.mark.parametrize(("spelling", "unit"), [("degk", "k"), ("kelvins", "k"), ("degc", "c"), ("degf", "f")])
def test_unlisted_temperatures_snap_by_scale_and_offset(known, spelling, unit):
    name = "CameraTemperature"
    stats = [(name, known, 500, quantiles(TO[known or "c"])), (name, spelling, 400, quantiles(TO[unit], 0.8))]
    assert resolve(stats)[name, spelling] == unit


def test_a_known_scale_with_another_offset_stays_unresolved():
    name = "CameraTemperature"
    stats = [(name, "", 500, quantiles(TO["c"])), (name, "°ra", 400, quantiles(lambda c: 1.8 * (c + 273.15)))]
    assert (name, "°ra") not in resolve(stats)


def test_unlisted_kelvin_amounts(spark):
    rows = [("CameraTemperature", f"{n / 2 - 10}", None, None) for n in range(80)]
    rows += [("CameraTemperature", f"{n / 2 - 10 + 273.15:.2f} kelvins", None, None) for n in range(80)]
    got = [r["amount"] for r in harmonise(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert sorted(got) == sorted([5 * n - 100 for n in range(80)] * 2)


def drawn(seed, n, spellings):
    """Values of one population for each (quantity, spelling, unit), written in that unit."""
    rng = random.Random(seed)
    base = {"FocalLength": lambda: rng.uniform(0.01, 0.6), "GPSAltitude": lambda: rng.uniform(-100, 4000),
            "CameraTemperature": lambda: rng.uniform(-15, 50), "FileSize": lambda: rng.uniform(1e6, 6e7)}
    rows, want = [], {}
    for quantity, spelling, unit in spellings:
        scale, offset = DIMENSIONS[units.QUANTITIES[quantity][0]][unit]
        per = units.QUANTITIES[quantity][2]
        for _ in range(n):
            truth = base[quantity]()
            rows.append((len(rows), quantity, f"{(truth - offset) / scale:.9f} {spelling}".strip(), None, None))
            want[len(rows) - 1] = truth * per
    return rows, want


def test_without_any_spelling_nearly_all_amounts_are_the_same(spark, monkeypatch):
    spellings = [("FocalLength", "", "mm"), ("FocalLength", "cm", "cm"), ("FocalLength", "inches", "in"), ("FocalLength", "m", "m"),
                 ("FocalLength", "um", "um"), ("GPSAltitude", "", "m"), ("GPSAltitude", "feet", "ft"), ("GPSAltitude", "km", "km"),
                 ("CameraTemperature", "", "c"), ("CameraTemperature", "k", "k"), ("CameraTemperature", "f", "f"),
                 ("FileSize", "", "b"), ("FileSize", "mb", "mb"), ("FileSize", "gb", "gb"), ("FileSize", "mib", "mib")]
    rows, want = drawn(3, 4000, spellings)
    df = spark.createDataFrame(rows, "n int, " + COLUMNS)
    monkeypatch.setattr(units, "SPELLINGS", {d: {u: [] for u in known} for d, known in units.SPELLINGS.items()})
    got = {r["n"]: r["amount"] for r in harmonise(df).collect()}
    right = sum(abs(got.get(n, 1e18) - x) <= 1 + 1e-3 * abs(x) for n, x in want.items())
    assert right >= 0.99 * len(want), right / len(want)


def test_shared_entities_overrule_a_wrong_spelling(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        mm = rng.uniform(10, 600)
        rows += [(i, "FocalLength", f"{mm:.2f}", None, None, f"e{i}"), (i, "FocalLength", f"{mm / 10:.3f} m", None, None, f"e{i}")]
    rows += [(1000, "FocalLength", "5 m", None, None, None), (1001, None, "5 m", None, None, "e1"), (1002, "FocalLength", None, None, None, "e1")]
    df = spark.createDataFrame(rows, "n int, " + COLUMNS + ", entity string")
    amounts = {r["n"]: r["amount"] for r in harmonise(df).collect()}
    assert amounts[1000] == 500
    verdict = {(r["quantity"], r["source"]): r for r in units.judged_sources(df).collect()}["FocalLength", "m"]
    assert verdict["unit"] == "cm" and verdict["decided_by"] == "estimate against spelling" and verdict["n"] == 200


def test_populations_alone_do_not_overrule_a_spelling():
    q = [float(x) for x in range(10, 100, 10)]
    stats = [("ExposureTime", "", 5000, q), ("ExposureTime", "ms", 900, [x * 10 for x in q]), ("ExposureTime", "tick", 900, [x * 31 for x in q])]
    verdicts = judge(stats)
    assert verdicts["ExposureTime", "ms"].unit == "ms" and verdicts["ExposureTime", "ms"].by == "spelling"
    assert verdicts["ExposureTime", "tick"].unit is None


def test_two_units_that_are_as_near_leave_a_source_unresolved():
    q = [1e6 * x for x in range(5, 50, 5)]
    assert ("FileSize", "units") not in resolve([("FileSize", "", 400, q), ("FileSize", "units", 400, [x / 1012 for x in q])])

import json
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from darkslide.operators.timestamps import READINGS, fit_mixture, normalise_times

COLUMNS = "source string, value string, number double, own_zone string, local_zone string"


def at(*parts, zone=None):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone) if zone else UTC).timestamp())


def read(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + COLUMNS)
    return {r["n"]: r for r in normalise_times(df).collect()}


WRITTEN = [
    ("2020:08:26 22:59:48", "Europe/Berlin", at(2020, 8, 26, 22, 59, 48, zone="Europe/Berlin")),
    ("2020-08-26T22:59:48.123456+0930", None, at(2020, 8, 26, 13, 29, 48)),
    ("2020-08-26T22:59:48,005-07", None, at(2020, 8, 27, 5, 59, 48)),
    ("2013:10:14 23:05:38−04:00", None, at(2013, 10, 15, 3, 5, 38)),
    ("20130501T231608Z", None, at(2013, 5, 1, 23, 16, 8)),
    ("2014:08:09 04:49", "UTC", at(2014, 8, 9, 4, 49)),
    ("  2019:06:18 04:10:46 ", "UTC", at(2019, 6, 18, 4, 10, 46)),
    ("Sun, 08 Mar 2015 04:18:33 -0400", None, at(2015, 3, 8, 8, 18, 33)),
    ("7 Feb 2015 22:28:42 GMT", None, at(2015, 2, 7, 22, 28, 42)),
    ("December 27, 2022 12:35:30 PM CET", None, at(2022, 12, 27, 11, 35, 30)),
    ("September 18, 2020 12:09:32 AM", "Asia/Tokyo", at(2020, 9, 17, 15, 9, 32)),
    ("Tue Jan  2 16:32:58 2018", "UTC", at(2018, 1, 2, 16, 32, 58)),
    ("2021-04-29T21:58:07[America/St_Johns]", "UTC", at(2021, 4, 29, 21, 58, 7, zone="America/St_Johns")),
    ("2016-10-05 20:59:06 America/New_York", "UTC", at(2016, 10, 5, 20, 59, 6, zone="America/New_York")),
    ("1663211181", None, 1663211181),
    ("1380109406201", None, 1380109406),
    # a time that occurs twice is the first; a skipped one keeps the offset before the change
    ("2020:10:25 02:30:00", "Europe/Berlin", at(2020, 10, 25, 0, 30)),
    ("2021:03:28 02:30:00", "Europe/Berlin", at(2021, 3, 28, 1, 30)),
    ("2021:04:04 01:45:00", "Australia/Lord_Howe", at(2021, 4, 3, 14, 45)),
]


def test_written_forms(spark):
    got = read(spark, [("t", v, None, None, zone) for v, zone, _ in WRITTEN])
    assert {i: r["utc_second"] for i, r in got.items()} == {i: w for i, (_, _, w) in enumerate(WRITTEN)}


def test_no_instant(spark):
    none = ["", "   ", None, "2015", "2018-05", "2014:02:03", "unknown", "    :  :     :  :  ", "0000:00:00 00:00:00",
            "2019:13:41 25:61:00", "2019:02:30 10:00:00", "0000000000", "January 40, 2020 1:00:00 AM", "x" * 10000]
    assert read(spark, [("t", v, None, None, "UTC") for v in none]) == {}


def test_zone_order(spark):
    got = read(
        spark,
        [
            ("t", "2020:01:01 12:00:00", None, "+02:00", "Asia/Tokyo"),
            ("t", "2020:01:01 12:00:00+01:00", None, "+02:00", "Asia/Tokyo"),
            ("t", "2020:01:01 12:00:00", None, "rubbish", "Asia/Tokyo"),
            ("t", "2020:01:01 12:00:00", None, None, None),
        ],
    )
    assert [got[i]["utc_second"] - at(2020, 1, 1) for i in range(4)] == [36000, 39600, 10800, 43200]
    assert [got[i]["ambiguous"] for i in range(4)] == [False, False, False, True]


@pytest.mark.parametrize(
    ("number", "second"),
    [
        (1429079371.5, 1429079371),
        (1526733504000.0, 1526733504),
        (1525241122493500.0, 1525241122),
        (1.305866544525e17, 1414191854),
    ],
)
def test_units_and_origins(spark, number, second):
    assert read(spark, [("mtime", None, number, None, None)])[0]["utc_second"] == pytest.approx(second, abs=10)


def test_numbers_without_meaning(spark):
    rows = [("mtime", None, x, None, None) for x in (None, float("nan"), float("inf"), -1.0, 0.0, 12.0)]
    assert read(spark, rows) == {}


def test_mixture_decides_between_orders(spark):
    clear = [("eu", f"{d}.03.2015 10:00:00", None, None, "UTC") for d in range(13, 29)]
    got = read(spark, [*clear, ("eu", "07.02.2015 10:00:00", None, None, "UTC")])
    assert got[16]["utc_second"] == at(2015, 2, 7, 10) and not got[16]["ambiguous"]
    american = [("us", f"03/{d}/2015 10:00:00", None, None, "UTC") for d in range(13, 29)]
    got = read(spark, [*american, ("us", "02/07/2015 10:00:00", None, None, "UTC")])
    assert got[16]["utc_second"] == at(2015, 2, 7, 10) and got[16]["reading"] == "mdy"


def test_undecided_order_is_marked(spark):
    got = read(spark, [("few", "07.02.2015 10:00:00", None, None, "UTC")])
    assert got[0]["ambiguous"] and got[0]["posterior"] == pytest.approx(0.5)


def test_fit_prefers_what_only_one_reading_explains():
    both, first = 0b11, 0b01
    out = fit_mixture(pd.DataFrame({"source": ["s", "s"], "mask": [both, first], "n": [100, 20]}))
    assert list(out["reading"]) == [0, 0] and out["posterior"].min() > 0.99 and READINGS[0] == "dmy"


def test_a_minority_keeps_its_own_order(spark):
    rows = [("many", f"{d}/03/2015 10:00:00", None, None, "UTC") for d in range(13, 29)] * 20
    rows += [("few", f"03/{d}/2015 10:00:00", None, None, "UTC") for d in range(13, 29)] * 3
    rows += [("few", "02/07/2015 10:00:00", None, None, "UTC"), ("many", "02/07/2015 10:00:00", None, None, "UTC")]
    got = read(spark, rows)
    assert got[len(rows) - 2]["utc_second"] == at(2015, 2, 7, 10) and got[len(rows) - 2]["reading"] == "mdy"
    assert got[len(rows) - 1]["utc_second"] == at(2015, 7, 2, 10) and got[len(rows) - 1]["reading"] == "dmy"


def test_times_at_a_change_of_clocks_are_marked(spark):
    berlin, howe = "Europe/Berlin", "Australia/Lord_Howe"
    rows = [
        ("t", "2021-10-31 02:30:00", None, None, berlin),  # occurs twice
        ("t", "2021-03-28 02:30:00", None, None, berlin),  # is skipped
        ("t", "2021-10-31 01:59:59", None, None, berlin),
        ("t", "2021-10-31 03:00:00", None, None, berlin),
        ("t", "2021-07-01 02:30:00", None, None, berlin),
        ("t", "2021-04-04 01:45:00", None, None, howe),  # occurs twice, half an hour apart
        ("t", "2021-10-31 02:30:00+02:00", None, None, berlin),
    ]
    got = read(spark, rows)
    assert [got[i]["ambiguous"] for i in range(len(rows))] == [True, True, False, False, False, True, False]
    assert got[0]["utc_second"] == at(2021, 10, 31, 0, 30) and got[1]["utc_second"] == at(2021, 3, 28, 1, 30)
    assert got[0]["posterior"] == pytest.approx(0.5)


def test_abbreviations_with_several_meanings(spark):
    noon = at(2021, 1, 10, 12)
    rows = [
        ("a", "2021-01-10 12:00:00 IST", None, None, "Asia/Kolkata"),
        ("a", "2021-01-10 12:00:00 IST", None, None, None),
        ("b", "2021-01-10 12:00:00 CST", None, None, "America/Chicago"),
        ("a", "2021-01-10 12:00:00 JST", None, None, None),
    ]
    got = read(spark, rows)
    assert [noon - got[i]["utc_second"] for i in range(4)] == [19800, 19800, -21600, 32400]
    assert [got[i]["ambiguous"] for i in range(4)] == [False, True, False, False]
    china = [("c", "2021-01-10 12:00:00 CST", None, None, "Asia/Shanghai")] * 60
    got = read(spark, [*china, ("c", "2021-01-10 12:00:00 CST", None, None, None)])
    assert noon - got[0]["utc_second"] == 28800 and noon - got[60]["utc_second"] == 28800 and got[60]["posterior"] < 0.95


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([("s", "2020:01:01 00:00:00", None, None, "UTC", "kept")], COLUMNS + ", mask string")
    row = normalise_times(df).first()
    assert row["utc_second"] == at(2020, 1, 1)
    assert normalise_times(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    from darkslide.queries.general import p1_found

    images = [
        (1, "/a/x/p.jpg", json.dumps({"ExifIFD:DateTimeOriginal": "2020:07:01 12:00:00"}), 1.6e9),
        (2, "/a/q.jpg", json.dumps({"E:DateTimeOriginal": "2020:07:01 12:00:00", "E:OffsetTimeOriginal": "+05:00"}), None),
        (3, "/ab/q.jpg", json.dumps({"E:GPSDateTime": "2020:07:01 12:00:00", "Y": "2020:07:01 12:00:00"}), None),
        (4, "C:\\f\\q.jpg", json.dumps({"CreateDate": "2020:07:01 12:00:00"}), None),
    ]
    folders = [(1, "/a"), (2, "/a/x"), (3, "C:\\f"), (4, None)]
    zones = [(1, "Asia/Tokyo"), (2, "Europe/Berlin"), (3, "America/New_York"), (9, "UTC")]
    for name, rows, schema in (
        ("images", images, "id bigint, path string, metadata_json string, mtime double"),
        ("indexed_folders", folders, "id bigint, path string"),
        ("folder_zones", zones, "folder_id bigint, zone_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    noon = at(2020, 7, 1, 12)
    assert sorted(map(tuple, p1_found(spark, str(tmp_path)).collect())) == [
        (1, "ExifIFD:DateTimeOriginal", noon - 7200),
        (1, "mtime", 1600000000),
        (2, "E:DateTimeOriginal", noon - 18000),
        (3, "E:GPSDateTime", noon),
        (4, "CreateDate", noon + 4 * 3600),
    ]

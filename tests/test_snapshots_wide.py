import random
from datetime import datetime, timedelta

import pytest

from darkslide.operators.snapshots import snapshot_changes
from darkslide.operators.wide import outer_join_all, unreadable, widen

T0 = datetime(2024, 1, 1)
SNAP = "snapshot_no int, delivered_at timestamp, path string, mtime double, size bigint"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    return sorted(map(tuple, snapshot_changes(df, "path", ["mtime", "size"]).collect()))


def test_added_removed_changed(spark):
    rows = [
        (1, T0, "a", 1.0, 1),
        (1, T0, "b", 1.0, 1),
        (1, T0, "b", 1.0, 1),
        (1, T0, "c", 1.0, None),
        (4, T0, "a", 1.0, 2),
        (4, T0, "c", 1.0, None),
        (4, T0, "d", 1.0, 1),
        (9, T0, "a", 1.0, 2),
        (9, T0, "c", 1.0, 5),
        (9, T0, "d", 2.0, 1),
    ]
    assert changes(spark, rows) == [
        (4, "a", "changed"),
        (4, "b", "removed"),
        (4, "d", "added"),
        (9, "c", "changed"),
        (9, "d", "changed"),
    ]


def test_latest_delivery_counts(spark):
    late = T0 + timedelta(days=90)
    rows = [(1, T0, "a", 1.0, 1), (2, T0, "a", 2.0, 1), (2, late, "a", 1.0, 1)]
    assert changes(spark, rows) == []


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, T0, "a", 1.0, 1)]) == []
    rows = [(1, T0, None, 1.0, 1), (None, T0, "a", 1.0, 1), (1, None, "b", None, None), (2, None, "b", None, None)]
    assert changes(spark, rows) == []


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice([1, 2, 5]), T0 + timedelta(hours=rng.randint(0, 3)), rng.choice("abcdefgh"), float(rng.randint(0, 2)),
         rng.choice([None, 1, 2]))
        for _ in range(200)
    ]
    state: dict = {}
    for no, at, path, mtime, size in rows:
        key = (at, mtime, -1 if size is None else size)
        if path not in state.setdefault(no, {}) or key > state[no][path]:
            state[no][path] = key
    want = []
    for a, b in ((1, 2), (2, 5)):
        for p in set(state[a]) | set(state[b]):
            x, y = state[a].get(p), state[b].get(p)
            if x is None or y is None or x[1:] != y[1:]:
                want.append((b, p, "added" if x is None else "removed" if y is None else "changed"))
    assert changes(spark, rows) == sorted(want)


TYPES = [
    ("I", "n", "bigint"), ("I2", "n", "bigint"), ("D", "x", "double"), ("B", "flag", "boolean"), ("T", "day", "date"),
    ("S", "name", "string"), ("S2", "other", "string"), ("S3", "third", "string"),
]
META = "image_id bigint, tag string, tag_value string, recorded_at timestamp"


def wide(spark, rows):
    types = spark.createDataFrame(TYPES, "tag string, column_name string, value_type string")
    return widen(spark.createDataFrame(rows, META), types)


@pytest.mark.parametrize(
    ("tag", "good", "bad"),
    [
        ("I", ["5", " -3 ", "+7", "4.0", "4.", "9223372036854775807"], ["4.5", "1e3", "x", "9 px", "9223372036854775808", "NaN"]),
        ("D", ["2.8", ".5", "-1e-3", "+2/3", "7/1", "5."], ["f2.8", "2,8", "1/0", "NaN", "inf", "1.2.3", "about 2", "-"]),
        ("B", ["0", "1", "TRUE", "no", " Yes "], ["2", "-1", "on", "yes/no", "maybe"]),
        ("T", ["2020:02:29", "2020-12-01", "2020:01:05 25:99:00", "2021-1-3"], ["2021:02:29", "2020:01-05", "2020", "05/06/2020", "last week"]),
        ("S", ["anything", "  x "], []),
    ],
)
def test_types(spark, tag, good, bad):
    rows = [(i, tag, v, T0) for i, v in enumerate(good + bad)]
    got = {r["image_id"] for r in unreadable(wide(spark, rows)).collect()}
    assert got == set(range(len(good), len(good) + len(bad)))


def test_value_in_force(spark):
    later = T0 + timedelta(seconds=1)
    rows = [
        (1, "I", "bad", T0), (1, "I2", "7", later), (1, "I", "  ", later + timedelta(1)), (1, "I2", None, later),
        (2, "I", "7", T0), (2, "I2", "bad", later), (3, "S", "", T0), (None, "I", "3", T0), (4, "unlisted", "3", T0),
        (5, "S", "a", T0), (5, "S", "a", T0),
    ]
    table = wide(spark, rows)
    got = {r["image_id"]: r["n"] for r in table.collect()}
    assert got == {1: 7, 2: None, 5: None}
    assert [tuple(r) for r in unreadable(table).collect()] == [(2, "n")]


def test_empty_table(spark):
    table = wide(spark, [])
    assert table.count() == 0 and unreadable(table).count() == 0
    assert dict(table.dtypes)["day"] == "date"


def test_join_tree_keeps_every_column(spark):
    spine = spark.createDataFrame([(i,) for i in range(6)], "__entity bigint")
    tables = [spark.createDataFrame([(i % 6, i)], f"__entity bigint, c{i} int") for i in range(11)]
    got = outer_join_all(spine, tables, fan=3)
    assert got.count() == 6 and len(got.columns) == 12
    assert got.where("__entity = 4").first()["c10"] == 10


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, T0, "a", 1.0, 1, "x"), (2, T0, "a", 1.0, 1, "y")]
    df = spark.createDataFrame(rows, SNAP + ", change_kind string")
    assert snapshot_changes(df, "path", ["mtime", "size"]).count() == 0
    types = spark.createDataFrame(TYPES, "tag string, column_name string, value_type string")
    meta = spark.createDataFrame([(1, "I", "5", T0, "z", 3)], META + ", column_name string, n int")
    assert widen(meta, types).first()["n"] == 5


def test_one_key_with_a_third_of_all_rows(spark):
    rows = [(1 + i % 2, T0 + timedelta(seconds=i), "hot" if i % 3 else f"p{i}", float(i % 5), i) for i in range(3000)]
    got = changes(spark, rows)
    assert ("hot" in {p for _, p, _ in got}) and len(got) == len({(n, p) for n, p, _ in got})

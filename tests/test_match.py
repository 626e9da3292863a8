import itertools
import random
import sqlite3

import pytest

from darkslide.plans import index as inverted
from darkslide.plans import match
from darkslide.plans.search import Request, search, statistics, token_columns, tokenised

FTS = "id bigint, path string, filename string, metadata_text string"


def frame(spark, rows):
    return spark.createDataFrame([(i + 1, f"/l/{f}", f, t) for i, (f, t) in enumerate(rows)], FTS)


def ids(df, query):
    return sorted(r["id"] for r in tokenised(df).where(match.matches(match.parse(query), token_columns())).collect())


def by_index(df, query):
    return sorted(r["id"] for r in unstored(df).matching(match.parse(query)).collect())


def unstored(df):
    made = inverted.build(df)
    return inverted.Stored(inverted.postings(df), made.lengths, made.totals)


TWO = [("canon.jpg", "Make Canon lens 50mm"), ("nikon.jpg", "Make Nikon lens 50mm")]
CASES = [
    (TWO, "Canon", [1]),
    (TWO, "Leica", []),
    (TWO, "Canon AND 50mm", [1]),
    (TWO, "Canon OR Nikon", [1, 2]),
    (TWO, "50mm NOT Nikon", [1]),
    (TWO, "canon lens", [1]),
    (TWO, "Fuji*", []),
    (TWO, "Can*", [1]),
    ([("deer.jpg", "red deer wildlife"), ("fox.jpg", "red fox, wildlife deer")], '"red deer"', [1]),
    ([("hawk.jpg", "eagle soaring"), ("eagle.jpg", "hawk diving")], "filename:eagle", [2]),
    ([("hawk.jpg", "eagle soaring"), ("eagle.jpg", "hawk diving")], "metadata_text:eagle", [1]),
    ([("a.jpg", "Café"), ("b.jpg", "cafe\u0301"), ("c.jpg", "Cafe x")], "CAFÉ", [1, 2, 3]),
    ([("a.jpg", "night sky"), ("b.jpg", "the night")], "metadata_text:^night", [1]),
    ([("a.jpg", "iso_speed f/1.4"), ("b.jpg", "speed iso")], "iso_speed", [1]),
    ([("a.jpg", "x " + "m " * 10 + "y"), ("b.jpg", "x " + "m " * 11 + "y"), ("c.jpg", "y x")], "NEAR(x y)", [1, 3]),
    ([("a.jpg", None), (None, "")], "a", []),
]


@pytest.mark.parametrize(("rows", "query", "want"), CASES)
def test_language(spark, rows, query, want):
    df = frame(spark, rows)
    if query == "a":
        df = df.where("filename is null")
    assert ids(df, query) == want
    assert by_index(df, query) == want


@pytest.mark.parametrize("query", ['"open', "NOT x", "a AND NOT b", "(a", "camera:x", "*", "...", "(a OR b) c", "c (a OR b)", "t^", "AND", "a OR", "path:*", "NEAR()"])
def test_errors(query):
    with pytest.raises(match.QuerySyntaxError):
        match.parse(query)


def test_empty_phrases():
    assert match.parse('""') is None
    assert match.parse('"" a') == match.parse("a")


WORDS = ["ka", "lo", "mi", "ra"]


def _random_query(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.4:
        w = rng.choice(WORDS)
        return rng.choice([w, w, w[:1] + "*", f'"{w} {rng.choice(WORDS)}"', f"filename:{w}", f"^{w}", f"{w} {rng.choice(WORDS)}"])
    a, b = _random_query(rng, depth + 1), _random_query(rng, depth + 1)
    op = rng.choice(["AND", "OR", "NOT"])
    return f"({a}) {op} ({b})" if kind < 0.7 else f"{a} {op} {b}"


def test_scan_index_and_sqlite_agree(spark):
    """Random trees over all short documents, against the full-text engine that defines the language."""
    rng = random.Random(7)
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(path, filename, metadata_text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text extension")
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(0, 3))), " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for _ in range(60)]
    df = frame(spark, rows).cache()
    for r in df.collect():
        db.execute("insert into t(rowid, path, filename, metadata_text) values (?, ?, ?, ?)", (r["id"], r["path"], r["filename"], r["metadata_text"]))
    queries = [_random_query(rng) for _ in range(25)]
    queries += [" ".join(x) for x in itertools.product(["ka"], ["AND", "OR", "NOT", ""], ["lo"], ["AND", "OR", "NOT", ""], ["mi"])]
    for q in queries:
        want = [r[0] for r in db.execute("select rowid from t where t match ? order by rowid", (q,))]
        assert ids(df, q) == want, q
    for q in queries[:6]:
        assert by_index(df, q) == ids(df, q), q


@pytest.mark.parametrize("query", ["ka", "ka OR lo", "ka AND lo", "ka NOT lo", '"ka lo"', "ka*", "filename:ka", "ka OR (lo AND mi)", "ka ka", "(ka AND lo) OR mi"])
def test_rank_as_sqlite(spark, query):
    rng = random.Random(11)
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(path, filename, metadata_text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text extension")
    vocabulary = [*WORDS, *(f"w{i}" for i in range(30))]
    rows = [(" ".join(rng.choices(vocabulary, k=2)), " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for _ in range(50)]
    df = frame(spark, rows)
    for r in df.collect():
        db.execute("insert into t(rowid, path, filename, metadata_text) values (?, ?, ?, ?)", (r["id"], r["path"], r["filename"], r["metadata_text"]))
    want = dict(db.execute("select rowid, bm25(t) from t where t match ?", (query,)).fetchall())
    node = match.parse(query)
    weights, average = statistics(df, node)
    scored = tokenised(df).where(match.matches(node, token_columns()))
    got = {r[0]: r[1] for r in scored.select("id", match.score(node, token_columns(), weights, average)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_order_of_results(spark):
    df = frame(spark, [("b.jpg", "x"), ("B.jpg", "x x"), ("É.jpg", "y"), ("é.jpg", "y"), ("_.jpg", "x"), ("a.png", "x")])
    images = df.selectExpr("id", "path", "filename", "'{}' as metadata_json", "id as size", "cast(id as double) as mtime")
    names = [r["filename"] for r in search(images, df, Request()).collect()]
    assert names == ["_.jpg", "a.png", "B.jpg", "b.jpg", "É.jpg", "é.jpg"]
    newest = [r["id"] for r in search(images, df, Request("x", ext="jpg", sort="date_desc")).collect()]
    assert newest == [5, 2, 1]
    page = search(images, df, Request(sort="path_asc", limit=2, offset=4)).collect()
    assert [r["filename"] for r in page] == ["É.jpg", "é.jpg"]
    best = search(images, df, Request("x")).collect()
    assert [r["score"] for r in best] == sorted(r["score"] for r in best)


def test_stored_postings(spark):
    df = frame(spark, TWO)
    made = inverted.stored(spark, "two", lambda: df)
    assert inverted.stored(spark, "two", lambda: None) is made
    assert [r["id"] for r in made.matching(match.parse("lens NOT nikon")).collect()] == [1]
    assert tuple(made.totals.first()) == (2, 9.0)
    stored = made.postings
    plan = stored.where("term = 'lens'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,lens)]" in plan


def test_unions_of_equally_partitioned_rows_stay_distinct(spark):
    """Spread postings make the inputs of the union look alike; copies must still be found."""
    rows = [(f"f{i}.jpg", f"ka lo{i % 3}" + (" mi" if i % 2 else "")) for i in range(300)]
    df = frame(spark, rows)
    for q in ("(ka OR lo1) AND mi", "(ka OR mi) NOT lo2", "ka OR mi OR lo1"):
        got = [r["id"] for r in unstored(df).matching(match.parse(q)).collect()]
        assert len(got) == len(set(got)) and sorted(got) == ids(df, q)


def test_ranks_of_the_stored_index_are_those_of_the_scan(spark):
    df = frame(spark, [("a.jpg", "ka lo mi ka"), ("b.jpg", "lo mi x"), ("c.jpg", "ka x x x"), ("d.jpg", "")])
    images = df.selectExpr("id", "path", "filename", "'{}' as metadata_json", "id as size", "cast(id as double) as mtime")
    for q in ("ka", "ka OR lo", '"lo mi"', "ka OR (lo AND x)", "k* NOT lo", "NEAR(ka mi)", "nothing"):
        ranks = [{r["id"]: round(r["score"], 9) for r in search(images, i, Request(q)).collect()} for i in (df, unstored(df))]
        assert ranks[0] == ranks[1], q
    empty = unstored(df.limit(0))
    assert search(images, empty, Request("ka")).count() == 0

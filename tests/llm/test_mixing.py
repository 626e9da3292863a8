import random

import numpy as np
import pytest

from darkslide.llm.mixing import Cell, budgets, fitted, marginals, mix, rake, shares, violations

DOCS = "doc_id bigint, text string, lang string, source string, doc_kind string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = " ".join(rng.choices(["red", "deer", "night", "sky", "harbour", "market"], k=rng.randint(5, 60)))
            rows.append((len(rows), text, rng.choice(["en", "de", None]), source, rng.choice(["note", "card"])))
    rows += [(len(rows), None, "en", "a", "note"), (len(rows) + 1, "", None, "a", None)]
    return spark.createDataFrame(rows, DOCS)


def test_budgets_pass_on_what_a_source_lacks():
    got = budgets([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 10), ("none", 0.0, 1)], {"a": 1000, "b": 20, "c": 1000}, 400)
    assert got["b"] == 40 and sum(got.values()) == pytest.approx(400)
    assert got["a"] / got["c"] == pytest.approx(2.5)
    assert budgets([("a", 1.0, 1)], {}, 100) == {"a": 0.0}
    assert budgets([], {"a": 5}, 100) == {}


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(3)
    cells = [Cell(s, la, t, float(rng.integers(50, 500)), 10) for s in "abc" for la in "xyz" for t in "pq"]
    tokens = np.array([c.tokens for c in cells])
    budget = {"a": 600.0, "b": 900.0, "c": 500.0}
    used = rake(cells, budget, {"a": 9, "b": 9, "c": 9}) * tokens
    for s, want in budget.items():
        assert used[[c.source == s for c in cells]].sum() == pytest.approx(want)
    for la in "xyz":
        mine = [c.lang == la for c in cells]
        assert used[mine].sum() / used.sum() == pytest.approx(tokens[mine].sum() / tokens.sum(), rel=0.01)


def test_raking_respects_repeats():
    cells = [Cell("a", "x", "p", 10.0, 1), Cell("a", "y", "p", 100.0, 1), Cell("b", "y", "q", 1000.0, 1)]
    weights = rake(cells, {"a": 200.0, "b": 500.0}, {"a": 2, "b": 1})
    assert weights[:2].max() <= 2 + 1e-9 and (weights[:2] * [10, 100]).sum() == pytest.approx(200)


def test_mixture(spark):
    docs = corpus(spark, {"a": 900, "b": 60, "c": 300, "unlisted": 200})
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("absent", 0.1, 5)], TARGETS)
    rows = mix(docs, targets).collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert rows and all(1 <= r["uses"] <= most[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    report = {r["source"]: r for r in shares(docs, targets).collect()}
    assert report["absent"]["used_tokens"] == 0 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    for r in report.values():
        assert abs(r["used_tokens"] - r["planned_tokens"]) <= 6 * 60
    assert report["a"]["of_corpus"] == pytest.approx(0.5, abs=0.03)
    assert sorted(map(tuple, mix(docs, targets).collect())) == sorted(map(tuple, rows))


def test_marginals_are_reported(spark):
    docs = corpus(spark, {"a": 900, "b": 60, "c": 300, "unlisted": 200})
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("absent", 0.1, 5)], TARGETS)
    rows = {(r["side"], r["name"]): r for r in marginals(docs, targets).collect()}
    assert {s for s, _ in rows} == {"source", "lang", "topic"} and ("lang", "?") in rows and ("source", "absent") in rows
    for side in ("source", "lang", "topic"):
        mine = [r for (s, _), r in rows.items() if s == side]
        assert sum(r["wanted_share"] for r in mine) == pytest.approx(1) and sum(r["used_share"] for r in mine) == pytest.approx(1)
        assert all(abs(r["gap"]) < 0.03 for r in mine)
    assert all(r["moved"] <= 1e-6 and 1 <= r["rounds"] <= 200 for r in rows.values())
    assert violations(docs, targets).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert marginals(empty, targets.limit(0)).count() == 0 and violations(empty, targets).count() == 0


def test_fit_tells_when_it_stopped():
    cells = [Cell("a", "x", "p", 10.0, 1), Cell("a", "y", "p", 100.0, 1)]
    weights, rounds, moved = fitted(cells, {"a": 55.0}, {"a": 1})
    assert weights == pytest.approx([0.5, 0.5]) and rounds < 200 and moved <= 1e-9


def test_one_text_copied_many_times(spark):
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "'the same text' as text", "'en' as lang", "if(id % 3 = 0, 'hot', 'b') as source", "'note' as doc_kind"
    )
    targets = spark.createDataFrame([("hot", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    got = {r["source"]: r["documents"] for r in shares(docs, targets).collect()}
    assert abs(got["hot"] - 750) <= 1 and abs(got["b"] - 750) <= 1


def test_empty(spark):
    docs = corpus(spark, {"a": 3})
    none = spark.createDataFrame([], TARGETS)
    assert mix(docs, none).count() == 0 and shares(docs, none).count() == 0
    assert mix(docs.limit(0), spark.createDataFrame([("a", 1.0, 2)], TARGETS)).count() == 0
    nulls = spark.createDataFrame([(None, 0.5, 1), ("a", None, None)], TARGETS)
    assert mix(docs, nulls).count() == 0

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.operators.lists import explode_lists, split_lists


def split(*values, bar=False):
    return split_lists(pa.array(values, pa.string()), pa.array([bar] * len(values), pa.bool_())).to_pylist()


def brute(text, bar):
    """One value, character by character."""
    marks = [";", ",", "\t", "\n", "\r", "•", "，", "、", "；", " / "] + ([] if bar else ["|"])
    quoting = text.count('"') % 2 == 0
    items, item, i, inside = [], "", 0, False
    while i < len(text):
        if quoting and text[i] == '"':
            inside = not inside
            item += text[i]
            i += 1
            continue
        mark = None if inside else next((m for m in marks if text.startswith(m, i)), None)
        if mark:
            items.append(item)
            item = ""
            i += len(mark)
        else:
            item += text[i]
            i += 1
    items.append(item)
    out = []
    for x in items:
        x = x.strip()
        if len(x) >= 2 and x[0] == x[-1] == '"':
            x = x[1:-1].replace('""', '"').strip()
        if x:
            out.append(x)
    return out


def test_delimiters_quotes_and_blanks():
    assert split("a; b;;c", '"bridge; old";"dune";"the ""Kettle""" ') == [
        ["a", "b", "c"],
        ["bridge; old", "dune", 'the "Kettle"'],
    ]
    assert split("f/1.4 / barn", "夜景、x；y，z • q", "x\ty\nz") == [["f/1.4", "barn"], list("夜景") and ["夜景", "x", "y", "z", "q"], ["x", "y", "z"]]


def test_bracketed_lists():
    assert split('["x", "y, z", "\\u00e9"]', "['a', \"fisherman's hut\"]", "[not, a list]") == [
        ["x", "y, z", "é"],
        ["a", "fisherman's hut"],
        ["not", "a list"],
    ]


def test_bar_joins_levels():
    assert split("Places|Coast, B|C", bar=True) == [["Places|Coast", "B|C"]]


def test_null_empty_blank_and_unbalanced():
    assert split(None, "", "  ", " ; ;", '12" print; b') == [[], [], [], [], ['12" print', "b"]]
    assert split_lists(pa.array([], pa.string()), pa.array([], pa.bool_())).to_pylist() == []


def test_repeats_stay_and_slices_work():
    values = pa.array(["z", "a,a", "b;b;b", "q"])
    assert split_lists(values.slice(1, 2), pa.array([False, False])).to_pylist() == [["a", "a"], ["b", "b", "b"]]


def test_very_long_value():
    text = ";".join(f"w{i}" for i in range(50_000))
    assert len(split(text)[0]) == 50_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab ";,|/•、é\t', max_size=14), max_size=5), st.booleans())
def test_same_as_character_by_character(values, bar):
    values = [v for v in values if not (v.strip().startswith("[") and v.strip().endswith("]"))]
    assert split(*values, bar=bar) == [brute(v, bar) for v in values]


def test_explode_keeps_positions_and_other_columns(spark):
    rows = [(1, "IPTC:Keywords", "a;;b", False), (2, "X", None, False), (3, "H", "p|q, r|s", True)]
    df = spark.createDataFrame(rows, "id bigint, tag string, value string, hierarchical boolean")
    got = sorted(map(tuple, explode_lists(df).collect()))
    assert got == [
        (1, "IPTC:Keywords", 1, "a"),
        (1, "IPTC:Keywords", 2, "b"),
        (3, "H", 1, "p|q"),
        (3, "H", 2, "r|s"),
    ]
    assert explode_lists(df.limit(0)).count() == 0
    clash = df.withColumnRenamed("tag", "item")
    assert explode_lists(clash).columns == ["id", "pos", "item"]


def test_query_on_json(spark, tmp_path):
    from darkslide.queries.general import p3_found

    images = [
        (1, json.dumps({"IPTC:Keywords": "a; b", "Other": "x;y"})),
        (2, "not json"),
        (3, None),
        (4, "{}"),
        (5, json.dumps({"Keywords": ["c", "d"], "XMP-lr:HierarchicalSubject": "A|B"})),
    ]
    spark.createDataFrame(images, "id bigint, metadata_json string").write.parquet(str(tmp_path / "images.parquet"))
    got = sorted(map(tuple, p3_found(spark, str(tmp_path)).collect()))
    assert got == [
        (1, "IPTC:Keywords", 1, "a"),
        (1, "IPTC:Keywords", 2, "b"),
        (5, "Keywords", 1, "c"),
        (5, "Keywords", 2, "d"),
        (5, "XMP-lr:HierarchicalSubject", 1, "A|B"),
    ]

import html
import json
import os
import random
import re
from collections import Counter
from pathlib import PurePosixPath, PureWindowsPath

import pytest

from darkslide.functions.entries import tag_map
from darkslide.functions.text import find_all, highlighted, json_object, merged_ranges, metadata_text, pretty_json, step
from darkslide.operators import catalog, export, registry
from darkslide.operators.ingest import build_index
from darkslide.plans.search import Request, count, facets
from darkslide.plans.tree import folder_counts, folder_tree
from darkslide.queries.catalogue import QUERIES
from darkslide.sources.scan import BLACKLIST, blacklisted, is_picture, scan_folders
from pyspark.sql import functions as F

IMAGES = "id bigint, path string, filename string, mtime double, size bigint, metadata_json string"
NAMES = ["alpha.jpg", "beta.jpg", "gamma.jpg", "delta.jpeg", "epsilon.png", "zeta.png", "eta.tif", "plain"]


def images(spark, paths):
    rows = [(i + 1, p, p.rsplit("/", 1)[-1], float(i), i * 100, "{}") for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, IMAGES)


@pytest.fixture(scope="module")
def mixed(spark):
    return images(spark, [f"/l/{n}" for n in NAMES])


def test_extension_filter_and_facets(mixed):
    index = mixed.selectExpr("id", "path", "filename", "filename as metadata_text")
    n = lambda **w: count(mixed, index, Request(**w)).first()["n"]
    assert (n(), n(ext="jpg"), n(ext=".JPEG"), n(ext="png"), n(ext="tif"), n(ext="tiff")) == (8, 4, 1, 2, 1, 0)
    assert n(query="alpha", ext="png") == 0
    got = {r["ext"]: r["n"] for r in facets(mixed, index, Request(ext="png")).collect()}
    assert got == {"jpg": 4, "png": 2, "tif": 1}


def test_folder_filters_are_literal(spark):
    df = images(spark, ["/src1/a.jpg", "/src10/a.jpg", "/SRC1/b.jpg", "/a_b/c.jpg", "/aXb/c.jpg", "/src1"])
    n = lambda **w: count(df, df, Request(**w)).first()["n"]
    assert n(folder="/src1") == 2 and n(folder="/src1/../src1/") == 2 and n(folder="/a_b") == 1
    assert n(excluded=["/src1", "/src10"]) == 3 and n(folder="/") == 0


def test_tree(spark):
    df = images(spark, ["/r/a/x/1.jpg", "/r/a/x/2.jpg", "/r/b/3.jpg"])
    got = sorted(map(tuple, folder_tree(df).collect()))
    assert got == [("/r", "r", 0, 0), ("/r/a", "a", 1, 0), ("/r/a/x", "x", 2, 2), ("/r/b", "b", 1, 1)]
    assert sorted(map(tuple, folder_counts(images(spark, ["/c.jpg"])).collect())) == [("", 1)]
    assert folder_tree(df.limit(0)).count() == 0


def test_upsert_and_deletes(spark):
    df = images(spark, ["/a/1.jpg", "/a/2.jpg", "/b/1.jpg"])
    new = spark.createDataFrame(
        [(None, "/a/1.jpg", "1.jpg", 9.0, 9, '{"x":"y"}'), (None, "/c/1.jpg", "1.jpg", 1.0, 1, "{}")], IMAGES
    )
    merged = {r["path"]: r for r in catalog.upsert(df, new).collect()}
    assert merged["/a/1.jpg"]["id"] == 1 and merged["/a/1.jpg"]["size"] == 9 and len(merged) == 4
    assert merged["/c/1.jpg"]["id"] is not None
    kept = spark.createDataFrame([("/a/2.jpg",)], "path string")
    paths = lambda d: sorted(r["path"] for r in d.collect())
    assert paths(catalog.delete_missing(df, kept)) == ["/a/2.jpg"]
    assert paths(catalog.delete_missing(df, kept, ["/a"])) == ["/a/2.jpg", "/b/1.jpg"]
    assert paths(catalog.delete_below(df, "/a/")) == ["/b/1.jpg"]
    assert paths(catalog.delete_below(df, "/none")) == paths(df)
    assert paths(catalog.force_wipe(df, ["/b"])) == ["/a/1.jpg", "/a/2.jpg"]


def test_changes_are_exact(spark):
    df = images(spark, ["/a", "/b", "/c"])
    scan = spark.createDataFrame(
        [("/a", "a", 0.0, 0), ("/b", "b", 1.0000001, 100), ("/d", "d", 0.0, 0), ("/c", "c", 2.0, None)],
        "path string, filename string, mtime double, size bigint",
    )
    got = {r["path"]: r["status"] for r in catalog.changes(scan, df).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "changed", "/d": "new"}


REGISTRY = "id bigint, path string, display_name string, enabled boolean, recursive boolean, status string, image_count bigint, last_scanned_at double, error_message string"


def test_registry(spark):
    empty = spark.createDataFrame([], REGISTRY)
    one = registry.add(empty, "/photos/trip/")
    row = one.first()
    assert (row["id"], row["display_name"], row["status"], row["enabled"], row["image_count"]) == (1, "trip", "new", True, 0)
    assert registry.add(one, "/photos/x/../trip").count() == 1
    off = registry.set_enabled(one, 1, False)
    assert off.first()["status"] == "disabled" and registry.disabled_paths(off).count() == 1
    assert registry.set_enabled(off, 1, True).first()["status"] == "indexed"
    done = registry.update_status(one, 1, "indexed", image_count=42, error_message="e")
    assert done.first()["image_count"] == 42
    queued = registry.update_status(done, 1, "queued").first()
    assert queued["image_count"] == 0 and queued["error_message"] is None and queued["last_scanned_at"] > 1e9
    assert registry.pending(registry.update_status(done, 1, "queued")).count() == 1
    assert registry.remove(one, 99).count() == 1 and registry.remove(one, 1).count() == 0


def test_lifecycle():
    assert registry.transition("new", "queue") == "queued"
    assert registry.transition("scanning", "close") == "queued"
    assert registry.transition("scanning", "cancel") == "new"
    assert registry.transition("error", "disable") == "disabled"
    assert registry.transition("disabled", "finish") == "disabled"
    assert registry.next_in_queue([(1, False)], (1, False)) == [(1, False)]
    assert registry.next_in_queue([(1, False)], (1, True)) == [(1, False), (1, True)]


def test_names(spark):
    names = ["a.JPG", "b.cr2", ".jpg", "c.txt", "d", "e.tar.nef", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(is_picture(F.col("n"))).collect()] == [True, True, False, False, False, True, None]
    paths = ["/a/@eaDir/x.jpg", "/a/.hidden/x.jpg", "/a/Thumbs.db", "/a/x.jpg", "C:\\@eaDir\\x.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(blacklisted(F.col("p"), BLACKLIST)).collect()] == [True, True, True, False, True]
    assert not df.select(blacklisted(F.col("p"), [])).first()[0]


def test_exports(spark):
    rows = [(1, "/a", "a", 0.0, 0, json.dumps({"K": "v", "path": "over"})), (2, "/b", "b", 0.0, 0, "bad"), (3, "/c", "c", 0.0, 0, json.dumps({"k": "w", "FileName": "f"}))]
    df = spark.createDataFrame(rows, IMAGES)
    wide = export.wide_csv(df)
    assert wide.columns == ["path", "filename", "FileName (2)", "K", "k (2)"]
    assert [tuple(r) for r in wide.orderBy("path").collect()] == [
        ("/b", "b", "", "", ""),
        ("/c", "c", "f", "", "w"),
        ("over", "a", "", "v", ""),
    ]
    assert sorted(map(tuple, export.tag_rows(df).collect())) == [(1, "K", "v"), (1, "path", "over"), (3, "FileName", "f"), (3, "k", "w")]
    nested = spark.createDataFrame([('{"G": {"a": 1, "b": true}, "S": "x", "L": [1, 2]}',)], "j string")
    assert nested.select(export.flattened(F.col("j"))).first()[0] == {"G:a": "1", "G:b": "true", "S": "x", "L": "[1,2]"}
    work = export.thumbnail_worklist(df, export.cache_names(df.where("id = 1")).selectExpr("replace(cache_name, '.png', '.skip') as name"), ["/c"])
    assert [r["id"] for r in work.collect()] == [2, 3]  # a folder's own path isn't below it


def test_thumbnails_leave_out_folders_not_their_siblings(spark):
    paths = ["/library/a.jpg", "/library2/a.jpg", "/library/sub/b.jpg", "/x/library/c.jpg"]
    rows = [(i, p, p.rsplit("/", 1)[1], 1.0, None if i == 1 else 5, "{}") for i, p in enumerate(paths)] + [(9, "/y", "y", 0.0, 1 << 31, "{}")]
    df = spark.createDataFrame(rows, IMAGES)
    none = spark.createDataFrame([], "name string")
    work = export.thumbnail_worklist(df, none, ["/library/../library/"])
    assert sorted(r["id"] for r in work.collect()) == [1, 3]
    have = export.cache_names(df.where("id = 3")).selectExpr("cache_name as name")
    assert tuple(export.thumbnail_counters(df, have, ["/library"]).first()) == (3, 1, 2)
    assert export.thumbnail_worklist(spark.createDataFrame([], IMAGES), none).count() == 0


def test_listed_cache(spark, tmp_path):
    for name in ("a.png", "b.skip", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in export.listed_cache(spark, str(tmp_path)).collect()) == ["a.png", "b.skip"]
    assert export.listed_cache(spark, str(tmp_path / "none")).count() == 0


def test_written_exports(spark, tmp_path):
    import csv

    rows = [(1, "/a", "a", 0.5, 3, json.dumps({"K": 'say "x", y\nz', "G": {"a": 1}})), (2, "/b", "b", 0.0, None, "bad")]
    df = spark.createDataFrame(rows, IMAGES).coalesce(1)
    export.write_csv(df, str(tmp_path / "csv"))
    file = next((tmp_path / "csv").glob("*.csv"))
    with open(file, newline="", encoding="utf-8") as f:
        made = list(csv.reader(f))
    assert made == [["path", "filename", "G:a", "K"], ["/a", "a", "1", 'say "x", y\nz'], ["/b", "b", "", ""]]
    assert export.write_json(df, str(tmp_path / "json")) and not export.write_json(df, str(tmp_path / "no"), cancelled=True)
    back = [json.loads(x) for x in next((tmp_path / "json").glob("*.json")).read_text().splitlines()]
    assert back[0]["metadata"]["K"] == 'say "x", y\nz' and back[1]["path"] == "/b" and not (tmp_path / "no").exists()


def test_tag_table_and_json(spark):
    rows = [(1, "/a", "a", 0.0, 0, json.dumps({"b": "2", "A": "1", "É": "4", "c": 'q"\\'}))]
    df = spark.createDataFrame(rows, IMAGES)
    assert [r["tag"] for r in export.tag_table(df, 1).collect()] == ["A", "b", "c", "É"]
    made = df.select(json_object(tag_map(F.col("metadata_json"))).alias("j"), pretty_json(tag_map(F.col("metadata_json"))).alias("p")).first()
    known = {"b": "2", "A": "1", "É": "4", "c": 'q"\\'}
    assert made["j"] == json.dumps(known, ensure_ascii=False) and made["p"] == json.dumps(known, ensure_ascii=False, indent=2)


def test_registry_reads(spark):
    rows = [(2, "/b", "b", True, True, "new", 0, None, None), (1, "/a", "a", False, True, "disabled", 0, None, None)]
    df = spark.createDataFrame(rows, REGISTRY)
    assert [r["path"] for r in registry.everything(df).collect()] == ["/a", "/b"]
    assert registry.by_id(df, 2).first()["path"] == "/b" and registry.by_id(df, 9).count() == 0
    assert registry.exists(df, "/x/../a/") and not registry.exists(df, "/c") and registry.cleared(df).count() == 0


def test_steps_through_hits():
    assert [step([3, 9, 12], at) for at in (-1, 0, 2)] == [0, 1, 0] and step([], 0) == -1
    assert [step([3, 9, 12], at, forward=False) for at in (3, 0, 1)] == [2, 2, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("a<b aAa",)], "t string")
    assert df.select(find_all(F.col("t"), "aa")).first()[0] == [4, 5]
    assert df.select(find_all(F.col("t"), "")).first()[0] == []
    ranges = df.select(merged_ranges(find_all(F.col("t"), "aa"), 2)).first()[0]
    assert [tuple(r) for r in ranges] == [(4, 6)]
    html = df.select(highlighted(F.col("t"), "aa", "#fff")).first()[0]
    assert html == 'a&lt;b <span style="background-color:#fff">aA</span>a'
    text = spark.sql("select map('Make', 'Canon', 'D', 'Café & Co.') as m").select(metadata_text(F.col("m"))).first()[0]
    assert text == 'Make Canon D Café & Co. ' + json.dumps({"Make": "Canon", "D": "Café & Co."}, ensure_ascii=False)
    assert spark.sql("select map() as m").select(metadata_text(F.expr("cast(m as map<string,string>)"))).first()[0].endswith("{}")


def make_extractor():
    """Nested, so that it is sent to the workers by value."""

    def read(path):
        if "broken" in path:
            raise OSError(path)
        with open(path) as f:
            return {"File:Text": f.read(), "File:Calls": path}

    return read


extractor = make_extractor()


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_incremental_build(spark, tmp_path):
    root, other = str(tmp_path / "pics"), str(tmp_path / "more")
    write(root, "canon.jpg", "Canon")
    write(root, "nikon.png", "Nikon")
    write(root, "note.txt", "x")
    write(root + "/@eaDir", "thumb.jpg", "x")
    write(other, "leica.jpg", "Leica")
    kept = catalog.Catalog(spark, str(tmp_path / "catalog"))
    built = build_index(spark, kept, [root, other, str(tmp_path / "none")], extractor)
    assert (built.indexed, built.errors) == (3, 0)
    first = {r["filename"]: r["id"] for r in kept.read().collect()}
    from darkslide.plans.search import hits

    found = lambda q: sorted(r["filename"] for r in hits(kept.read(), kept.read("index"), Request(q)).collect())
    assert found("Canon") == ["canon.jpg"] and len(found("")) == 3
    write(root, "canon.jpg", "Canon changed")
    os.remove(os.path.join(root, "nikon.png"))
    write(root, "broken.jpg", "x")
    built = build_index(spark, kept, [root], extractor)
    assert (built.indexed, built.errors) == (1, 1)
    rows = {r["filename"]: r for r in kept.read().collect()}
    assert sorted(rows) == ["canon.jpg", "leica.jpg"] and rows["canon.jpg"]["id"] == first["canon.jpg"]
    assert found("changed") == ["canon.jpg"]
    os.remove(os.path.join(root, "broken.jpg"))
    os.remove(os.path.join(root, "canon.jpg"))
    assert build_index(spark, kept, [root], extractor).indexed == 0
    assert found("") == ["canon.jpg", "leica.jpg"]  # a scan that finds nothing deletes nothing
    build_index(spark, kept, [root], extractor, force=True)
    assert found("") == ["leica.jpg"]


def test_cancelled_run_deletes_nothing(spark, tmp_path):
    root = str(tmp_path / "pics")
    write(root, "a.jpg", "a")
    write(root, "b.jpg", "b")
    kept = catalog.Catalog(spark, str(tmp_path / "catalog"))
    build_index(spark, kept, [root], extractor)
    os.remove(os.path.join(root, "a.jpg"))
    build_index(spark, kept, [root], extractor, cancelled=lambda: True)
    assert kept.read().count() == 2


def test_engine(spark, tmp_path):
    from darkslide.engine import Engine

    alpha, beta = str(tmp_path / "alpha"), str(tmp_path / "beta")
    write(alpha, "a1.jpg", "Canon")
    write(beta, "b1.jpg", "Nikon")
    engine = Engine(spark, str(tmp_path / "catalog"), extractor)
    engine.add_folder(alpha)
    engine.add_folder(beta)
    for number in (1, 2):
        engine.scan(number)
    assert engine.count() == 2
    engine.enable(1, False)
    assert [r["filename"] for r in engine.search().collect()] == ["b1.jpg"]
    engine.enable(1, True)
    engine.remove_folder(2)
    assert engine.count() == 1 and engine.registry.count() == 1
    engine.reset()
    assert engine.count() == 0


def test_engine_searches_its_stored_index(spark, tmp_path):
    from darkslide.engine import Engine
    from darkslide.plans.index import Stored
    from darkslide.state import SearchState

    root = str(tmp_path / "pics")
    for i, words in enumerate(["red deer", "red fox", "grey fox"]):
        write(root, f"p{i}.jpg", words)
    write(root, "p3.png", "red kite")
    engine = Engine(spark, str(tmp_path / "catalog"), extractor)
    engine.add_folder(root)
    seen = []
    assert engine.scan(1, on_progress=lambda done, total: seen.append((done, total)), workers=3, json_path=str(tmp_path / "json")).indexed == 4
    assert seen == [(i + 1, 4) for i in range(4)]
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "json").glob("*.json")) == 4
    assert isinstance(engine.index, Stored) and engine.count("red") == 3 and engine.count('"red fox"') == 1
    state = SearchState()
    assert state.set_query(" red ") and not state.set_query("red")
    shown = engine.context(state, limit=2)
    assert shown.total == 3 and shown.results.count() == 2 and {r["ext"]: r["n"] for r in shown.facets.collect()} == {"jpg": 2, "png": 1}
    assert state.next_page(2) == (0, 2)
    state.took(2)
    assert state.next_page(2) == (2, 1) and engine.context(state, limit=2).results.count() == 1
    tree = engine.tree()
    assert engine.tree() is tree and tree.agg(F.sum("n")).first()[0] == 4
    engine.scan(1, json_path=str(tmp_path / "no"), cancelled=lambda: True)
    assert not (tmp_path / "no").exists() and engine.tree() is not tree


def test_engine_queue(spark, tmp_path):
    from darkslide.engine import Engine

    roots = [str(tmp_path / n) for n in "ab"]
    for r in roots:
        write(r, "x.jpg", "Canon")
    engine = Engine(spark, str(tmp_path / "catalog"), extractor)
    for r in roots:
        engine.add_folder(r)
    for request in ((1, False), (2, False), (1, False), (1, True)):
        engine.enqueue(*request)
    assert engine.queue == [(1, False), (2, False), (1, True)]
    assert {r["status"] for r in engine.registry.collect()} == {"queued"}
    engine.remove_folder(2)
    assert [b.indexed for b in engine.run_queue()] == [1, 1] and engine.queue == []
    engine.enqueue(1)
    again = Engine.open(spark, str(tmp_path / "catalog"), extractor)
    assert again.registry.first()["status"] == "indexed"


def test_of_two_writers_one_fails(spark, tmp_path):
    one = catalog.Catalog(spark, str(tmp_path / "catalog"))
    two = catalog.Catalog(spark, str(tmp_path / "catalog"))
    assert one.current() == (0, {}) and one.read() is None
    one.commit(images=images(spark, ["/a"]))
    start = two.current()[0]
    one.commit(images=images(spark, ["/a", "/b"]))
    with pytest.raises(catalog.Conflict):
        two.commit(after=start, images=images(spark, []))
    assert two.read().count() == 2


def test_files_without_a_stamp_are_errors(spark, tmp_path):
    root = str(tmp_path / "pics")
    write(root, "a.jpg", "a")
    write(root + "/deep/er", "b.jpg", "b")
    os.symlink(str(tmp_path / "gone"), os.path.join(root, "broken.jpg"))
    rows = {r["filename"]: r for r in scan_folders(spark, [root]).collect()}
    assert sorted(rows) == ["a.jpg", "b.jpg", "broken.jpg"] and rows["broken.jpg"]["mtime"] is None
    assert sorted(r["filename"] for r in scan_folders(spark, [root], recursive=False).collect()) == ["a.jpg", "broken.jpg"]
    kept = catalog.Catalog(spark, str(tmp_path / "catalog"))
    built = build_index(spark, kept, [root], extractor)
    assert (built.indexed, built.errors) == (2, 1) and kept.read().count() == 2


def test_extraction_tool(tmp_path):
    from darkslide.sources.scan import tool_extractor

    def tool(body):
        path = tmp_path / "tool"
        path.write_text("#!/bin/sh\n" + body)
        path.chmod(0o755)
        return (str(path),)

    answer = tool("""echo '[{"SourceFile": "x", "EXIF": {"ISO": 100, "Flag": true}, "L": [1]}]'""")
    assert tool_extractor(answer)("x.jpg") == {"SourceFile": "x", "EXIF:ISO": "100", "EXIF:Flag": "True", "L": "[1]"}
    assert tool_extractor(answer, notes=lambda p: {"PIL:dpi": "72"})("x.PNG")["PIL:dpi"] == "72"
    assert tool_extractor(tool("sleep 9"), timeout=0.3)("x.jpg") == {}
    for bad in ("echo nonsense", "exit 3", "echo '[]'", "echo '{}'"):
        assert tool_extractor(tool(bad))("x.jpg") == {}
    assert tool_extractor(("/no/such/tool",))("x.jpg") == {}


def test_settings(monkeypatch):
    from darkslide import config

    for said, meant in (("1", True), (" YES ", True), ("off", False), ("maybe", True), ("", True)):
        monkeypatch.setenv("DARKSLIDE_FLAG", said)
        assert config.env_flag("DARKSLIDE_FLAG", True) is meant
    assert not config.env_flag("DARKSLIDE_NONE", False)
    assert config.catalog_root("work", "/base") == config.catalog_root("work.db", "/base") == "/base/work"
    assert config.catalog_root("/x/y.db", "/base") == "/x/y.db" and config.catalog_root("a/b", "/base") == "a/b"
    assert [config.clamped(n, 8) for n in (-1, 3, 99)] == [1, 3, 8] and config.clamped(99, 64) == 16
    assert config.file_uri("/a b/é#.jpg") == "file:///a%20b/%C3%A9%23.jpg" and config.file_uri("C:\\x y.jpg") == "file:///C:/x%20y.jpg"


def test_search_state():
    from darkslide.state import SearchState

    state = SearchState(query="x", selected=4)
    assert state.browse("/a") and (state.query, state.folder) == ("", "/a")
    assert state.browse("/a") and state.folder == "" and state.set_ext(".JPG") and not state.set_ext("jpg")
    assert state.set_sort("no such") and not state.set_sort("filename_asc")
    assert state.found(9) == 4 and state.found(3) == 0 and SearchState().next_page() is None


def test_streamed_deliveries(spark, tmp_path):
    from darkslide.streaming.ingest import DELIVERY, keep_catalog, stream_deliveries

    inbox, kept = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "catalog"))
    empty = spark.createDataFrame([], IMAGES)
    rows = [("/a", "a", 1.0, 1, "{}"), ("/b", "b", 1.0, 1, "{}"), ("/a", "a", 2.0, 2, "{}")]
    spark.createDataFrame(rows, DELIVERY).write.parquet(inbox + "/x", mode="overwrite")
    keep_catalog(stream_deliveries(spark, inbox + "/*"), kept, empty, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("/b", "b", 5.0, 5, "{}")], DELIVERY).write.parquet(inbox + "/y")
    keep_catalog(stream_deliveries(spark, inbox + "/*"), kept, empty, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["path"], r["size"]) for r in kept.read().collect()) == [("/a", 2), ("/b", 5)]


def test_every_row_has_its_place(spark, tmp_path):
    rng = random.Random(3)
    n = 2500
    rows = [
        (i, f"/l/{rng.randrange(10**9)}/{i}", rng.choice(["a.jpg", "B.jpg", f"é{i % 7}"]), float(rng.randrange(5)),
         rng.randrange(3) if i % 9 else None, "{}")
        for i in range(n)
    ]
    images = spark.createDataFrame(rows, IMAGES)
    images.write.parquet(str(tmp_path / "images.parquet"))
    index = images.selectExpr("id", "path", "filename", "metadata_json as metadata_text")
    index.write.parquet(str(tmp_path / "images_fts.parquet"))
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    orders = {
        "filename_asc": (lambda r: low(r[2]), False), "filename_desc": (lambda r: low(r[2]), True),
        "path_asc": (lambda r: low(r[1]), False), "path_desc": (lambda r: low(r[1]), True),
        "date_asc": (lambda r: r[3], False), "date_desc": (lambda r: r[3], True),
        "size_desc": (lambda r: -1 if r[4] is None else r[4], True),
    }
    for name, (key, down) in orders.items():
        ordered = sorted(sorted(rows, key=lambda r: r[1]), key=key, reverse=down)
        got = {r["id"]: r["place"] for r in QUERIES[f"q_sort_{name}"](spark, str(tmp_path)).collect()}
        assert got == {r[0]: i + 1 for i, r in enumerate(ordered)}, name


def tree_by_hand(paths):
    """The tree as pathlib sees it, roots without the separator after them."""
    kinds = [PurePosixPath(p) if p.startswith("/") else PureWindowsPath(p) for p in paths]
    bare = lambda p: str(p).rstrip("\\") if isinstance(p, PureWindowsPath) else str(p)
    counts = Counter(bare(p.parent) for p in kinds)
    lines = {bare(p.parent): [p.parent, *p.parent.parents] for p in kinds}
    shared = set.intersection(*({bare(a) for a in line} for line in lines.values()))
    level = {bare(a): len(a.parts) for line in lines.values() for a in line}
    base = max((level[f] for f in shared), default=min(level.values()))
    names = {bare(a): a.name or bare(a) for line in lines.values() for a in line}
    return sorted((f, names[f], n - base, counts[f]) for f, n in level.items() if n >= base)


@pytest.mark.parametrize(
    "paths",
    [
        ["/r/a/x/1.jpg", "/r/b/2.jpg", "/s/3.jpg", "D:\\a\\4.jpg", "D:\\a\\b\\5.jpg", "E:\\6.jpg", "\\\\nas\\pub\\q\\7.jpg"],
        ["D:\\a\\b\\1.jpg", "D:\\a\\c\\d\\2.jpg", "D:\\a\\c\\d\\3.jpg"],
        ["D:\\a\\1.jpg", "D:\\b\\2.jpg"],
        ["\\\\nas\\pub\\q\\1.jpg", "\\\\nas\\pub\\2.jpg", "\\\\nas\\other\\r\\3.jpg"],
        ["/a/1.jpg", "/b/c/2.jpg"],
    ],
)
def test_tree_of_all_drives(spark, tmp_path, paths):
    rows = [(i, p, p.replace("\\", "/").rsplit("/", 1)[-1], 0.0, 0, "{}") for i, p in enumerate(paths)]
    spark.createDataFrame(rows, IMAGES).write.parquet(str(tmp_path / "images.parquet"))
    assert sorted(map(tuple, QUERIES["q_tree"](spark, str(tmp_path)).collect())) == tree_by_hand(paths)


def test_find_and_highlight_read_the_whole_text(spark, tmp_path):
    long = "x<00>" + "Ref 000 & 'é' " * 3000
    texts = ["ISO 100", "", None, "none", 'a "0" b', long]
    rows = [(i, "/p", "name", t) for i, t in enumerate(texts)]
    index = "id bigint, path string, filename string, metadata_text string"
    spark.createDataFrame(rows, index).write.parquet(str(tmp_path / "images_fts.parquet"))
    run = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    every = [(i, at) for i, t in enumerate(texts) for at, c in enumerate(t or "") if c == "0"]
    assert sorted(run("q_find_all")) == every
    kept = [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer("00", t or "")]
    assert sorted(run("q_highlight_ranges")) == kept
    span = '<span style="background-color:#fff176">00</span>'
    assert dict(run("q_highlight_html")) == {
        i: None if t is None else html.escape(t).replace("00", span) for i, t in enumerate(texts)
    }

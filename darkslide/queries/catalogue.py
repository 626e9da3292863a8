"""The queries of the catalogue engine itself, over images, images_fts, image_snapshots and indexed_folders.

Deliveries are taken from the snapshots: the latest snapshot is the scan that is compared with the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.entries import tag_map
from darkslide.functions.text import find_all, highlighted, json_object, merged_ranges, metadata_text, tokens
from darkslide.operators import catalog, export, registry
from darkslide.plans import index as inverted
from darkslide.plans import match, tree
from darkslide.plans.search import RESULT, Request, count, facets, filtered, hits, places, search
from darkslide.sources.scan import BLACKLIST, blacklisted, is_dotfile, is_picture
from darkslide.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images_fts")


def _stored(spark: SparkSession, d: str) -> inverted.Stored:
    """The stored index of the tables, built once in a session."""
    return inverted.stored(spark, d, lambda: _index(spark, d))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """The latest snapshot as a scan: one row per path."""
    rows = table(spark, d, "image_snapshots")
    last = rows.agg(F.max("snapshot_no")).first()[0]
    newest = F.max(F.struct("delivered_at", "mtime", "size", "filename")).alias("r")
    one = rows.where(F.col("snapshot_no") == last).groupBy("path").agg(newest)
    return one.select("path", "r.filename", "r.mtime", "r.size")


def _hit_ids(query: str) -> Query:
    return lambda s, d: hits(_images(s, d), _index(s, d), Request(query)).select("id")


def _index_ids(query: str) -> Query:
    return lambda s, d: _stored(s, d).matching(match.parse(query))


def _found(**wanted) -> Query:
    return lambda s, d: filtered(_images(s, d), Request(**wanted)).select(*RESULT)


def _sorted(name: str) -> Query:
    """The place of every picture in a named order."""
    return lambda s, d: places(_images(s, d), name)


def _page(offset: int, limit: int, **wanted) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return search(_images(s, d), _index(s, d), Request(limit=limit, offset=offset, **wanted)).select("id")

    return run


def _ranked(query: str, index: Callable[[SparkSession, str], DataFrame | inverted.Stored] = _stored) -> Query:
    """All matches with their score."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = search(_images(s, d), index(s, d), Request(query))
        return rows.select("id", F.round("score", 9).alias("score"))

    return run


def _count(**wanted) -> Query:
    return lambda s, d: count(_images(s, d), _index(s, d), Request(**wanted))


def _facets(**wanted) -> Query:
    return lambda s, d: facets(_images(s, d), _index(s, d), Request(**wanted))


def q_exclude_registry(s: SparkSession, d: str) -> DataFrame:
    """Pictures outside all disabled folders."""
    return registry.outside_disabled(_images(s, d).select("id", "path"), table(s, d, "indexed_folders")).select("id")


def q_distinct_keys(s: SparkSession, d: str) -> DataFrame:
    return export.distinct_keys(_images(s, d))


def q_tags(s: SparkSession, d: str) -> DataFrame:
    return export.tag_rows(_images(s, d))


def q_tokens(s: SparkSession, d: str) -> DataFrame:
    """How often each token occurs in the indexed texts."""
    return _index(s, d).select(F.explode(tokens(F.col("metadata_text"))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"))


def q_metadata_text(s: SparkSession, d: str) -> DataFrame:
    """The text that is indexed of each picture."""
    return _images(s, d).select("id", metadata_text(tag_map(F.col("metadata_json"))).alias("text"))


def q_upsert(s: SparkSession, d: str) -> DataFrame:
    """The catalogue after taking up the latest scan; new pictures are shown without their new id."""
    scan = _scan(s, d).withColumns({"id": F.lit(None).cast("bigint"), "metadata_json": F.lit("{}")})
    merged = catalog.upsert(_images(s, d), scan)
    known = _images(s, d).select("path").withColumn("known", F.lit(True))
    return merged.join(known, "path", "left").select(
        F.when(F.col("known"), F.col("id")).alias("id"), "path", "filename", "size", "mtime")


def q_delete_missing(s: SparkSession, d: str) -> DataFrame:
    return catalog.delete_missing(_images(s, d), _scan(s, d)).select("id", "path")


def q_delete_missing_scoped(s: SparkSession, d: str) -> DataFrame:
    roots = ["/archive", "/mnt/nas"]
    return catalog.delete_missing(_images(s, d), _scan(s, d), roots).select("id", "path")


def q_delete_prefix(s: SparkSession, d: str) -> DataFrame:
    return catalog.delete_below(_images(s, d), "/archive/src1").select("id", "path")


def q_force_wipe(s: SparkSession, d: str) -> DataFrame:
    return catalog.force_wipe(_images(s, d), ["/library", "/srv/photo"]).select("id", "path")


def _diff(status: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return catalog.changes(_scan(s, d), _images(s, d)).where(F.col("status") == status).select("path")

    return run


def q_index_counts(s: SparkSession, d: str) -> DataFrame:
    """The counters of a run in which files of unknown size couldn't be read."""
    status = F.when(F.col("size").isNull(), "error").otherwise("indexed")
    return catalog.run_counters(_scan(s, d).withColumn("status", status))


def q_registry_enabled(s: SparkSession, d: str) -> DataFrame:
    return registry.enabled(table(s, d, "indexed_folders")).select("id", "path")


def q_registry_pending(s: SparkSession, d: str) -> DataFrame:
    return registry.pending(table(s, d, "indexed_folders")).select("id", "path", "status")


def q_registry_disabled_paths(s: SparkSession, d: str) -> DataFrame:
    return registry.disabled_paths(table(s, d, "indexed_folders"))


def q_registry_set_enabled(s: SparkSession, d: str) -> DataFrame:
    return registry.set_enabled(table(s, d, "indexed_folders"), 6, True)


def q_registry_update(s: SparkSession, d: str) -> DataFrame:
    """Marking a folder as queued sets its count back to zero and its message to null."""
    return registry.update_status(table(s, d, "indexed_folders"), 2, "queued", last_scanned_at=1.7e9)


def q_registry_add(s: SparkSession, d: str) -> DataFrame:
    return registry.add(table(s, d, "indexed_folders"), "/library/new/../Nova Gorica")


def q_registry_remove(s: SparkSession, d: str) -> DataFrame:
    return registry.remove(table(s, d, "indexed_folders"), 7).select("id", "path")


def q_scan_extensions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "image_snapshots").select("path", "filename").distinct()
    return rows.where(is_picture(F.col("filename"))).select("path")


def q_scan_blacklist(s: SparkSession, d: str) -> DataFrame:
    return _images(s, d).where(~blacklisted(F.col("path"), BLACKLIST)).select("id")


def q_scan_dotfiles(s: SparkSession, d: str) -> DataFrame:
    return _images(s, d).where(~is_dotfile(F.col("filename"))).select("id")


def q_json_export(s: SparkSession, d: str) -> DataFrame:
    """The exported object of each picture, its metadata as JSON."""
    rows = export.json_rows(_images(s, d))
    return rows.select("path", "filename", "mtime", "size", json_object(F.col("metadata")).alias("metadata"))


def q_csv_wide(s: SparkSession, d: str) -> DataFrame:
    """All cells of the wide table, as a digest of the names and values of its columns in order."""
    wide = export.wide_csv(_images(s, d))
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in wide.columns[2:]]
    return wide.select("path", "filename", F.md5(F.concat_ws("\n", *cells)).alias("cells"),
                       F.lit(len(wide.columns)).alias("columns"))


def q_csv_query(s: SparkSession, d: str) -> DataFrame:
    """The wide table of what a query finds, with its columns only, in the order of its results."""
    wide = export.wide_csv(search(_images(s, d), _index(s, d), Request("harbour AND market")))
    return wide.select("path", F.lit(len(wide.columns)).alias("columns"))


def q_tag_table(s: SparkSession, d: str) -> DataFrame:
    return export.tag_table(_images(s, d), 1)


def q_find_all(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).select("id", F.explode(find_all(F.col("metadata_text"), "0")).alias("start"))


def q_highlight_ranges(s: SparkSession, d: str) -> DataFrame:
    starts = find_all(F.col("metadata_text"), "00")
    return _index(s, d).select("id", F.inline(merged_ranges(starts, 2)))


def q_highlight_html(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d).select("id", highlighted(F.col("metadata_text"), "00").alias("html"))


def _cached(s: SparkSession, d: str) -> DataFrame:
    """A cache that holds the thumbnails of the pictures in one root."""
    have = export.cache_names(_images(s, d).where(F.col("path").startswith("/archive/")))
    return have.select(F.col("cache_name").alias("name"))


def q_cache_names(s: SparkSession, d: str) -> DataFrame:
    return export.cache_names(_images(s, d).select("path", "mtime", "size")).select("path", "cache_name")


def q_thumb_counters(s: SparkSession, d: str) -> DataFrame:
    return export.thumbnail_counters(_images(s, d), _cached(s, d), ["/library"])


def q_registry_all(s: SparkSession, d: str) -> DataFrame:
    return registry.everything(table(s, d, "indexed_folders"))


def q_registry_by_id(s: SparkSession, d: str) -> DataFrame:
    return registry.by_id(table(s, d, "indexed_folders"), 5)


def q_thumb_worklist(s: SparkSession, d: str) -> DataFrame:
    rows = _images(s, d).select("id", "path", "mtime", "size")
    return export.thumbnail_worklist(rows, _cached(s, d), ["/library"]).select("id")


def q_search_combined(s: SparkSession, d: str) -> DataFrame:
    """Query, extension, folder and excluded folders together, ranked."""
    r = Request("harbour OR market NOT snow", ext="jpg", folder="/archive", excluded=["/archive/src1"])
    rows = search(_images(s, d), _index(s, d), r)
    return rows.select("id", "path", F.round("score", 9).alias("score"))


# One query per feature of the language: name -> text.
MATCHES = {
    "q_term": "harbour",
    "q_term_accent_case": "CAFÉ",
    "q_and": "harbour AND market",
    "q_implicit_and": "harbour market",
    "q_or": "harbour OR market",
    "q_not": "harbour NOT market",
    "q_precedence_1": "harbour OR market AND snow",
    "q_precedence_2": "harbour AND market NOT snow",
    "q_precedence_3": "harbour NOT market snow",
    "q_precedence_4": "harbour OR market NOT snow fox",
    "q_parens": "(harbour OR market) AND snow",
    "q_phrase": '"red deer"',
    "q_phrase_bareword": "f_number OR night_sky",
    "q_prefix": "harb*",
    "q_phrase_prefix": '"red de"*',
    "q_column_filename": "filename:dsc*",
    "q_column_group": "metadata_text:(harbour OR market)",
    "q_initial_token": "filename:^img",
    "q_near": 'NEAR("red deer" harbour)',
}
RANKED = {
    "q_bm25_or": "harbour OR market",
    "q_bm25_phrase": '"red deer"',
    "q_bm25_prefix": "harb*",
    "q_bm25_clamped": "mimetype",
    "q_bm25_nested": "harbour OR (market AND snow)",
}

QUERIES: dict[str, Query] = {
    "q_search_combined": q_search_combined,
    "q_scan_all": _found(),
    "q_stamps": lambda s, d: catalog.stamps(_images(s, d)),
    "q_ext_jpg": _found(ext="jpg"),
    "q_ext_jpeg": _found(ext=".JPEG"),
    "q_ext_nef": _found(ext="nef"),
    "q_path_include": _found(folder="/archive"),
    "q_path_sibling_prefix": _found(folder="/archive/src1"),
    "q_path_exclude": _found(excluded=["/archive/src1", "/library"]),
    "q_exclude_registry": q_exclude_registry,
    **{name: _hit_ids(text) for name, text in MATCHES.items()},
    **{name.replace("q_", "q_index_", 1): _index_ids(text) for name, text in MATCHES.items()},
    **{name: _ranked(text) for name, text in RANKED.items()},
    **{name.replace("q_", "q_scan_", 1): _ranked(text, _index) for name, text in RANKED.items()},
    "q_index_totals": lambda s, d: _stored(s, d).totals,
    "q_index_terms": lambda s, d: _stored(s, d).postings.groupBy("term").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("documents")),
    **{f"q_sort_{name}": _sorted(name) for name in
       ("filename_asc", "filename_desc", "path_asc", "path_desc", "date_desc", "date_asc", "size_desc")},
    "q_page_2": _page(10, 10, sort="path_asc"),
    "q_page_default_order": _page(0, 100, sort="no such order"),
    "q_count_blank": _count(query="  "),
    "q_count_query": _count(query="harbour", ext="jpg"),
    "q_facets_all": _facets(),
    "q_facets_query": _facets(query="harbour"),
    "q_facets_excluded": _facets(excluded=["/archive"]),
    "q_facets_ignore_ext": _facets(ext="png"),
    "q_folder_counts": lambda s, d: tree.folder_counts(_images(s, d)),
    "q_tree": lambda s, d: tree.folder_tree(_images(s, d)),
    "q_distinct_keys": q_distinct_keys,
    "q_tags": q_tags,
    "q_tokens": q_tokens,
    "q_metadata_text": q_metadata_text,
    "q_upsert": q_upsert,
    "q_delete_missing": q_delete_missing,
    "q_delete_missing_scoped": q_delete_missing_scoped,
    "q_delete_prefix": q_delete_prefix,
    "q_force_wipe": q_force_wipe,
    "q_diff_changed": _diff("changed"),
    "q_diff_unchanged": _diff("unchanged"),
    "q_diff_new": _diff("new"),
    "q_index_counts": q_index_counts,
    "q_registry_enabled": q_registry_enabled,
    "q_registry_pending": q_registry_pending,
    "q_registry_all": q_registry_all,
    "q_registry_by_id": q_registry_by_id,
    "q_registry_disabled_paths": q_registry_disabled_paths,
    "q_registry_set_enabled": q_registry_set_enabled,
    "q_registry_update": q_registry_update,
    "q_registry_add": q_registry_add,
    "q_registry_remove": q_registry_remove,
    "q_scan_extensions": q_scan_extensions,
    "q_scan_blacklist": q_scan_blacklist,
    "q_scan_dotfiles": q_scan_dotfiles,
    "q_json_export": q_json_export,
    "q_csv_wide": q_csv_wide,
    "q_csv_query": q_csv_query,
    "q_tag_table": q_tag_table,
    "q_find_all": q_find_all,
    "q_highlight_ranges": q_highlight_ranges,
    "q_highlight_html": q_highlight_html,
    "q_cache_names": q_cache_names,
    "q_thumb_worklist": q_thumb_worklist,
    "q_thumb_counters": q_thumb_counters,
}

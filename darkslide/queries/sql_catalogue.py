"""SQL twins of the catalogue queries, written apart from the plans: set operations on ids, strings of tokens and
plain predicates."""

from __future__ import annotations

from darkslide.functions.text import MARKS, UPPER, accents
from darkslide.sources.scan import RAW, STANDARD

_SRC, _DST = accents()


def _tokens(c: str) -> str:
    plain = f"translate(regexp_replace(coalesce({c}, ''), '{MARKS}', '', 'g'), '{_SRC}', '{_DST}')"
    return rf"regexp_extract_all(lower({plain}), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{UPPER.lower()}')"


TOKENS = f"""
with t as materialized (select id, {_tokens("path")} as p, {_tokens("filename")} as f, {_tokens("metadata_text")} as m
                        from images_fts),
s as materialized (select t.id, p, f, m, ' ' || array_to_string(p, ' ') || ' ' as sp,
                   ' ' || array_to_string(f, ' ') || ' ' as sf, ' ' || array_to_string(m, ' ') || ' ' as sm from t),
q as (select * from s where id in (select id from images))
"""


def _any(text: str, columns: str = "pfm") -> str:
    return "(" + " or ".join(f"contains(s{c}, '{text}')" for c in columns) + ")"


def _ids(condition: str, source: str) -> str:
    return f"(select id from {source} where {condition})"


def _matching(source: str) -> dict[str, str]:
    def term(word: str) -> str:
        return _ids(_any(f" {word} "), source)

    def both(a: str, b: str) -> str:
        return f"(select id from {a} intersect select id from {b})"

    def either(a: str, b: str) -> str:
        return f"(select id from {a} union select id from {b})"

    def without(a: str, b: str) -> str:
        return f"(select id from {a} except select id from {b})"

    h, m, n, x = term("harbour"), term("market"), term("snow"), term("fox")
    near = " or ".join(
        f"regexp_matches(s{c}, ' red deer (?:[^ ]+ ){{0,10}}harbour ') "
        f"or regexp_matches(s{c}, ' harbour (?:[^ ]+ ){{0,10}}red deer ')"
        for c in "pfm"
    )
    conditions = {
        "q_term": h,
        "q_term_accent_case": term("cafe"),
        "q_and": both(h, m),
        "q_implicit_and": both(h, m),
        "q_or": either(h, m),
        "q_not": without(h, m),
        "q_precedence_1": either(h, both(m, n)),
        "q_precedence_2": both(h, without(m, n)),
        "q_precedence_3": without(h, both(m, n)),
        "q_precedence_4": either(h, without(m, both(n, x))),
        "q_parens": both(either(h, m), n),
        "q_phrase": term("red deer"),
        "q_phrase_bareword": either(term("f number"), term("night sky")),
        "q_prefix": _ids(_any(" harb"), source),
        "q_phrase_prefix": _ids(_any(" red de"), source),
        "q_column_filename": _ids(_any(" dsc", "f"), source),
        "q_column_group": _ids(_any(" harbour ", "m") + " or " + _any(" market ", "m"), source),
        "q_initial_token": _ids("starts_with(sf, ' img ')", source),
        "q_near": _ids(near, source),
    }
    return {name: TOKENS + "select id from " + c for name, c in conditions.items()}


def _tf(word: str) -> str:
    return " + ".join(f"len(list_filter({c}, lambda x: x = '{word}'))" for c in "pfm")


def _tf_prefix(word: str) -> str:
    return " + ".join(f"len(list_filter({c}, lambda x: starts_with(x, '{word}')))" for c in "pfm")


def _tf_pair(a: str, b: str) -> str:
    return " + ".join(
        f"len(list_filter(range(1, greatest(len({c}), 1)), lambda i: {c}[i] = '{a}' and {c}[i + 1] = '{b}'))"
        for c in "pfm"
    )


def _ranking(parts: list[str], match: str, gates: list[str] | None = None) -> str:
    """BM25 over parts, each a term frequency; `match` and `gates` speak of tf0, tf1, and so on."""
    tfs = ", ".join(f"{tf} as tf{i}" for i, tf in enumerate(parts))
    counts = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(parts)))
    pieces = []
    for i in range(len(parts)):
        idf = f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 then ln((n - df{i} + 0.5) / (df{i} + 0.5)) else 1e-6 end)"
        one = f"-{idf} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / average))"
        pieces.append(f"(case when {gates[i]} then {one} else 0 end)" if gates else f"({one})")
    return f"""
{TOKENS}, w as (select id, len(p) + len(f) + len(m) as dl, {tfs} from s),
c as (select count(*)::double as n, avg(dl) as average, {counts} from w)
select id, round({" + ".join(pieces)}, 9) as score from w, c where ({match}) and id in (select id from images)
"""


def _ext(*names: str) -> str:
    return "(" + " or ".join(f"ends_with({_low('filename')}, '.{n}')" for n in names) + ")"


def _below(folder: str) -> str:
    return f"starts_with({_low('path')}, '{folder}/')"


RESULT = "select id, path, filename, metadata_json, size, mtime from images"
SCAN = """
with scan as (select path, filename, mtime, size from image_snapshots
              where snapshot_no = (select max(snapshot_no) from image_snapshots)
              qualify row_number() over (partition by path order by delivered_at desc, mtime desc nulls last,
                                         size desc nulls last, filename desc nulls last) = 1)
"""


def _place(order: str) -> str:
    return f"select id, row_number() over (order by {order}, path) as place from images"


def _facets(where: str) -> str:
    ext = _low("regexp_extract(filename, '[.]([^.]*)$', 1)")
    return f"""select case when e = 'jpeg' then 'jpg' else e end as ext, count(*) as n
        from (select {ext} as e, * from images) where e <> '' and {where} group by 1"""


_IN_HARBOUR = f"id in ({TOKENS} select id from {_ids(_any(' harbour '), 'q')})"
_MAP = "cast(cast(metadata_json as json) as map(varchar, varchar))"
_OBJECT = """'{' || array_to_string(list_transform(range(1, len(k) + 1), lambda i: cast(to_json(k[i]) as varchar) || ': ' ||
    coalesce(cast(to_json(v[i]) as varchar), 'null')), ', ') || '}'"""
_REGISTRY = "id, path, display_name, enabled, recursive, status, image_count, last_scanned_at, error_message"
_ESCAPED = """replace(replace(replace(replace(replace(metadata_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '"', '&quot;'), '''', '&#x27;')"""
_THUMB = "sha1(path || '|' || cast(mtime as varchar) || '|' || cast(size as varchar)) || '.png'"

SQL: dict[str, str] = {
    **_matching("q"),
    **{k.replace("q_", "q_index_", 1): v for k, v in _matching("s").items()},
    "q_search_combined": f"""select r.id, i.path, r.score from (
        {_ranking([_tf("harbour"), _tf("market"), _tf("snow")],
                  "tf0 > 0 or (tf1 > 0 and tf2 = 0)", ["tf0 > 0", "tf1 > 0 and tf2 = 0", "false"])}) r
        join images i on i.id = r.id where {_ext("jpg", "jpeg")} and {_below("/archive")}
        and not {_below("/archive/src1")}""",
    "q_scan_all": RESULT,
    "q_stamps": "select path, mtime, size from images",
    "q_ext_jpg": f"{RESULT} where {_ext('jpg', 'jpeg')}",
    "q_ext_jpeg": f"{RESULT} where {_ext('jpeg')}",
    "q_ext_nef": f"{RESULT} where {_ext('nef')}",
    "q_path_include": f"{RESULT} where {_below('/archive')}",
    "q_path_sibling_prefix": f"{RESULT} where {_below('/archive/src1')}",
    "q_path_exclude": f"{RESULT} where not {_below('/archive/src1')} and not {_below('/library')}",
    "q_exclude_registry": r"""select id from images i where not exists (select 1 from indexed_folders f
        where not f.enabled and (starts_with(i.path, f.path || '/') or starts_with(i.path, f.path || '\')))""",
    "q_bm25_or": _ranking([_tf("harbour"), _tf("market")], "tf0 > 0 or tf1 > 0"),
    "q_bm25_phrase": _ranking([_tf_pair("red", "deer")], "tf0 > 0"),
    "q_bm25_prefix": _ranking([_tf_prefix("harb")], "tf0 > 0"),
    "q_bm25_clamped": _ranking([_tf("mimetype")], "tf0 > 0"),
    "q_bm25_nested": _ranking(
        [_tf("harbour"), _tf("market"), _tf("snow")],
        "tf0 > 0 or (tf1 > 0 and tf2 > 0)",
        ["tf0 > 0", "tf1 > 0 and tf2 > 0", "tf1 > 0 and tf2 > 0"],
    ),
    "q_index_totals": f"{TOKENS} select count(*) as documents, avg(len(p) + len(f) + len(m)) as average from s",
    "q_index_terms": f"""{TOKENS}, w as (select id, unnest(list_concat(p, list_concat(f, m))) as term from s)
        select term, count(*) as n, count(distinct id) as documents from w group by 1""",
    "q_sort_filename_asc": _place(_low("filename")),
    "q_sort_filename_desc": _place(_low("filename") + " desc"),
    "q_sort_path_asc": _place(_low("path")),
    "q_sort_path_desc": _place(_low("path") + " desc"),
    "q_sort_date_desc": _place("mtime desc"),
    "q_sort_date_asc": _place("mtime"),
    "q_sort_size_desc": _place("size desc"),
    "q_page_2": f"select id from images order by {_low('path')}, path limit 10 offset 10",
    "q_page_default_order": f"select id from images order by {_low('filename')}, path limit 100",
    "q_count_blank": "select count(*) as n from images",
    "q_count_query": f"select count(*) as n from images where {_ext('jpg', 'jpeg')} and {_IN_HARBOUR}",
    "q_facets_all": _facets("true"),
    "q_facets_query": _facets(_IN_HARBOUR),
    "q_facets_excluded": _facets(f"not {_below('/archive')}"),
    "q_facets_ignore_ext": _facets("true"),
    "q_folder_counts": """select substr(path, 1, greatest(length(path) - length(filename) - 1, 0)) as folder,
        count(*) as n from images group by 1""",
    "q_tree": r"""
        with d as (select substr(path, 1, greatest(length(path) - length(filename) - 1, 0)) as folder, count(*) as n
                   from images group by 1),
        f as (select folder, replace(folder, '\', '/') as s, starts_with(folder, '\\') as share from d where folder <> ''),
        c as (select *, list_filter(range(1, length(s) + 1), lambda i: s[i] = '/' and i > 1 and s[i - 1] <> '/') as cuts from f),
        w as (select folder, share, s, list_concat(
                case when share then list_filter(cuts, lambda i: i > 2)[2:] when s[1] = '/' then list_concat([2], cuts) else cuts end,
                [length(s) + 1]) as ends from c),
        e as (select distinct folder, substr(folder, 1, u - 1) as path, i as level from (
                select folder, unnest(ends) as u, unnest(range(1, len(ends) + 1)) as i from w)),
        k as (select path, min(level) as level, count(*) as below from e group by 1),
        b as (select coalesce(max(level) filter (where below = (select count(*) from f)), min(level)) as base from k)
        select k.path, case when level = 1 then k.path else regexp_extract(k.path, '[^/\\]*$') end as name,
               cast(level - base as integer) as depth, coalesce(d.n, 0) as n
        from k cross join b left join d on d.folder = k.path where level >= base""",
    "q_distinct_keys": f"select distinct unnest(map_keys({_MAP})) as tag from images",
    "q_tags": f"select id, unnest(map_keys({_MAP})) as tag, unnest(map_values({_MAP})) as value from images",
    "q_tokens": f"select term, count(*) as n from (select unnest({_tokens('metadata_text')}) as term from images_fts) group by 1",
    "q_metadata_text": f"""select id, concat_ws(' ', array_to_string(flatten(list_transform(range(1, len(k) + 1),
        lambda i: [k[i], v[i]])), ' '), {_OBJECT}) as text
        from (select id, map_keys({_MAP}) as k, map_values({_MAP}) as v from images)""",
    "q_upsert": f"""{SCAN} select i.id, coalesce(s.path, i.path) as path, coalesce(s.filename, i.filename) as filename,
        case when s.path is null then i.size else s.size end as size,
        case when s.path is null then i.mtime else s.mtime end as mtime
        from images i full join scan s on s.path = i.path""",
    "q_delete_missing": f"{SCAN} select id, path from images where path in (select path from scan)",
    "q_delete_missing_scoped": f"""{SCAN} select id, path from images where path in (select path from scan)
        or not ({_below("/archive")} or {_below("/mnt/nas")})""",
    "q_delete_prefix": f"select id, path from images where not {_below('/archive/src1')}",
    "q_force_wipe": f"select id, path from images where not {_below('/library')} and not {_below('/srv/photo')}",
    "q_diff_changed": f"""{SCAN} select s.path from scan s join images i on i.path = s.path
        where not coalesce(i.mtime = s.mtime and i.size = s.size, false)""",
    "q_diff_unchanged": f"""{SCAN} select s.path from scan s join images i on i.path = s.path
        where i.mtime = s.mtime and i.size = s.size""",
    "q_diff_new": f"{SCAN} select path from scan where path not in (select path from images)",
    "q_index_counts": f"""{SCAN} select count(*) filter (where size is not null) as indexed,
        count(*) filter (where size is null) as errors from scan""",
    "q_registry_enabled": "select id, path from indexed_folders where enabled",
    "q_registry_all": f"select {_REGISTRY} from indexed_folders",
    "q_registry_by_id": f"select {_REGISTRY} from indexed_folders where id = 5",
    "q_registry_pending": "select id, path, status from indexed_folders where enabled and status in ('queued', 'scanning')",
    "q_registry_disabled_paths": "select path from indexed_folders where not enabled",
    "q_registry_set_enabled": """select id, path, display_name, enabled or id = 6 as enabled, recursive,
        case when id = 6 then 'indexed' else status end as status, image_count, last_scanned_at, error_message
        from indexed_folders""",
    "q_registry_update": """select id, path, display_name, enabled, recursive,
        case when id = 2 then 'queued' else status end as status, case when id = 2 then 0 else image_count end as
        image_count, case when id = 2 then 1.7e9 else last_scanned_at end as last_scanned_at,
        case when id = 2 then null else error_message end as error_message from indexed_folders""",
    "q_registry_add": f"""select {_REGISTRY} from indexed_folders union all
        select (select max(id) + 1 from indexed_folders), '/library/Nova Gorica', 'Nova Gorica', true, true, 'new', 0,
        null, null""",
    "q_registry_remove": "select id, path from indexed_folders where id <> 7",
    "q_scan_extensions": f"""select path from (select distinct path, filename from image_snapshots)
        where regexp_matches({_low("filename")}, '^[^.].*[.]({"|".join(STANDARD + RAW)})$')""",
    "q_scan_blacklist": r"""select id from images where len(list_filter(string_split(replace(path, '\', '/'), '/'),
        lambda x: regexp_full_match(x, '[.].*|Thumbs[.]db|desktop[.]ini|@eaDir'))) = 0""",
    "q_scan_dotfiles": "select id from images where not starts_with(filename, '.')",
    "q_json_export": f"""select path, filename, mtime, size, {_OBJECT} as metadata
        from (select *, map_keys({_MAP}) as k, map_values({_MAP}) as v from images)""",
    "q_csv_wide": f"""with m as (select path, filename, {_MAP} as m from images),
        n as (select key, row_number() over (partition by lower(key) order by key) + cast(lower(key) in ('path', 'filename') as integer) as n
              from (select distinct unnest(map_keys(m)) as key from m)),
        k as (select list(key order by key) as keys, list(case when n > 1 then key || ' (' || n || ')' else key end order by key) as names from n)
        select path, filename, md5(array_to_string(list_transform(range(1, len(keys) + 1),
            lambda i: names[i] || '=' || coalesce(m[keys[i]], '')), chr(10))) as cells, cast(len(keys) + 2 as integer) as columns
        from m cross join k""",
    "q_csv_query": f"""with h as (select path, {_MAP} as m from images
            where id in ({TOKENS} select id from {_ids(_any(' harbour '), 'q')} intersect select id from {_ids(_any(' market '), 'q')}))
        select path, cast((select count(distinct key) from (select unnest(map_keys(m)) as key from h)) + 2 as integer) as columns
        from h""",
    "q_tag_table": f"""select unnest(map_keys({_MAP})) as tag, unnest(map_values({_MAP})) as value from images where id = 1""",
    "q_find_all": """select id, cast(i - 1 as integer) as start from (
        select id, metadata_text as t, unnest(range(1, length(metadata_text) + 1)) as i from images_fts) where t[i] = '0'""",
    "q_highlight_ranges": """with c as (select id, string_split(metadata_text, '00') as x from images_fts),
        r as (select id, unnest(list_transform(range(1, len(x)), lambda k:
                list_sum(list_transform(x[1:k], lambda y: length(y))) + 2 * (k - 1))) as start from c)
        select id, cast(start as integer) as start, cast(start + 2 as integer) as end from r""",
    "q_highlight_html": f"""select id, replace({_ESCAPED}, '00',
        '<span style="background-color:#fff176">00</span>') as html from images_fts""",
    "q_cache_names": f"select path, {_THUMB} as cache_name from images",
    "q_thumb_counters": f"""with c as (select {_THUMB} in (select {_THUMB} from images where starts_with(path, '/archive/')) as have
            from images where not starts_with(path, '/library/'))
        select count(*) as total, count(*) filter (where have) as cached, count(*) filter (where not have) as missing from c""",
    "q_thumb_worklist": f"""select id from images where coalesce(size <= 1073741824, true) and not starts_with(path, '/library/')
        and {_THUMB} not in (select {_THUMB} from images where starts_with(path, '/archive/'))""",
}
SQL |= {k.replace("q_", "q_scan_", 1): v for k, v in SQL.items() if k.startswith("q_bm25_")}

"""SQL twins of the queries on times, lists and quantities in the JSON of pictures. They share nothing with the operators:
times are read by the database's own parser of dates, and units have their own table here."""

from __future__ import annotations


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ENTRIES = """
o as (select id, path, mtime, cast(cast(metadata_json as json) as map(varchar, varchar)) as m from images),
e as (select id, path, m, tag, value, regexp_extract(tag, '[^:]*$') as name
      from (select id, path, m, unnest(map_keys(m)) as tag, unnest(map_values(m)) as value from o)
      where value is not null)
"""


def _sibling(name: str) -> str:
    return f"(m[list_filter(map_keys(m), lambda k: regexp_extract(k, '[^:]*$') = '{name}')[1]])"


# Units as they are written, with what one is in metres, seconds, bytes and dots per inch.
METRES = {"um": 1e-6, "μm": 1e-6, "mm": 1e-3, "millimeters": 1e-3, "millimetres": 1e-3, "cm": 1e-2, "m": 1.0, "meters": 1.0,
          "metres": 1.0, "km": 1e3, "in": 0.0254, "inch": 0.0254, "inches": 0.0254, '"': 0.0254, "″": 0.0254, "ft": 0.3048,
          "feet": 0.3048, "'": 0.3048, "′": 0.3048}
SECONDS = {"s": 1.0, "sec": 1.0, "seconds": 1.0, '"': 1.0, "″": 1.0, "ms": 1e-3, "msec": 1e-3, "us": 1e-6, "μs": 1e-6, "min": 60.0}
BYTES = {"": 1.0, "b": 1.0, "byte": 1.0, "bytes": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "kib": 1024.0, "mib": 1048576.0, "gib": 1073741824.0}
DOTS = {"": 1.0, "dpi": 1.0, "ppi": 1.0, "2": 1.0, "inches": 1.0, "inch": 1.0, "dpcm": 2.54, "dots/cm": 2.54, "px/cm": 2.54,
        "pixels/cm": 2.54, "3": 2.54, "cm": 2.54}
CELSIUS = {"": (1.0, 0.0), "c": (1.0, 0.0), "°c": (1.0, 0.0), "deg c": (1.0, 0.0), "f": (1 / 1.8, -32 / 1.8), "°f": (1 / 1.8, -32 / 1.8),
           "deg f": (1 / 1.8, -32 / 1.8), "k": (1.0, -273.15)}

_ROWS = [("FocalLength", w, x * 1e4, 0.0) for w, x in {**METRES, "": 1e-3}.items()]
_ROWS += [("GPSAltitude", w, x * 10, 0.0) for w, x in {**METRES, "": 1.0}.items()]
_ROWS += [("SubjectDistance", w, x * 100, 0.0) for w, x in {**METRES, "": 1.0}.items()]
_ROWS += [("ExposureTime", w, x * 1e6, 0.0) for w, x in {**SECONDS, "": 1.0}.items()]
_ROWS += [("FileSize", w, x, 0.0) for w, x in BYTES.items()] + [("XResolution", w, x, 0.0) for w, x in DOTS.items()]
_ROWS += [("CameraTemperature", w, a * 10, b * 10) for w, (a, b) in CELSIUS.items()]
_UNITS = ", ".join(f"({_quoted(q)}, {_quoted(w)}, {a!r}::double, {b!r}::double)" for q, w, a, b in _ROWS)
_NAMES = "'FocalLength', 'ExposureTime', 'GPSAltitude', 'SubjectDistance', 'CameraTemperature', 'FileSize', 'XResolution'"
_BOTH = r"^([+-]?[0-9]+(?:[.][0-9]+)?)\s*(?:''|′|ft|feet)\s*([0-9]+(?:[.][0-9]+)?)\s*(?:\"|″|in|inches)$".replace('\\"', '"')
_ONE = r"^([+-]?(?:[0-9][0-9.,]*|[.][0-9]+))\s*(?:/\s*([0-9]+(?:[.][0-9]+)?))?\s*([^0-9]*)$"

P4_FOUND = rf"""
with {ENTRIES},
u(quantity, spelling, scale, shift) as (values {_UNITS}),
c as (select id, tag, name, replace(replace(trim(value), '−', '-'), 'µ', 'μ') as v,
             lower(trim({_sibling("ResolutionUnit")})) as resolution, lower(trim({_sibling("GPSAltitudeRef")})) as ref
      from e where name in ({_NAMES})),
p as (select *, regexp_matches(v, '{_BOTH}') as feet, regexp_matches(v, '{_ONE}') as one,
             regexp_extract(v, '{_ONE}', 1) as top, regexp_extract(v, '{_ONE}', 2) as bottom,
             lower(trim(regexp_extract(v, '{_ONE}', 3))) as rest from c),
n as (select *, case when regexp_matches(top, '^[+-]?[1-9][0-9]{{0,2}}(?:,[0-9]{{3}})+(?:[.][0-9]*)?$') then replace(top, ',', '')
                     when regexp_matches(top, '^[+-]?[0-9]+,[0-9]+$') then replace(top, ',', '.') else top end as t from p),
x as (select *, case when feet then try_cast(regexp_extract(v, '{_BOTH}', 1) as double)
                                     + try_cast(regexp_extract(v, '{_BOTH}', 2) as double) / 12
                     when one and bottom = '' then try_cast(t as double)
                     when one then try_cast(t as double) / nullif(try_cast(bottom as double), 0) end as x,
             case when feet then 'ft' else regexp_replace(trim(regexp_replace(rest, '(above|below) sea level$', '')), '[.]$', '') end as unit
      from n),
y as (select x.*, x.x * u.scale + u.shift as exact
      from x join u on u.quantity = x.name and u.spelling =
        case when x.name = 'XResolution' and x.unit = '' then coalesce(x.resolution, '') else x.unit end
      where x.x is not null)
select id, tag, cast(round(round(case when ends_with(rest, 'below sea level')
    or (name = 'GPSAltitude' and coalesce(ref in ('1', 'below sea level'), false)) then -abs(exact) else exact end, 6))
    as bigint) as amount from y
"""

_PLAIN = r'(?:"[^"]*"|[^";,\t\n\r•，、；|])+'
_LEVELS = r'(?:"[^"]*"|[^";,\t\n\r•，、；])+'

P3_FOUND = rf"""
with {ENTRIES},
k as (select id, tag, name, value, trim(value, e' \t\n\r') as t from e
      where name in ('Keywords', 'Subject', 'XPKeywords', 'HierarchicalSubject')),
l as (select id, tag, case
        when starts_with(t, '[') and ends_with(t, ']') and json_valid(t) then cast(cast(t as json) as varchar[])
        when starts_with(t, '[') and ends_with(t, ']') then
          list_transform(regexp_extract_all(t, '''[^'']*''|"[^"]*"'), lambda x: substr(x, 2, length(x) - 2))
        else list_transform(list_transform(
               case when name = 'HierarchicalSubject' then regexp_extract_all(replace(value, ' / ', ';'), '{_LEVELS}')
                    else regexp_extract_all(replace(value, ' / ', ';'), '{_PLAIN}') end,
               lambda x: trim(x, e' \t\n\r')),
             lambda x: case when length(x) >= 2 and starts_with(x, '"') and ends_with(x, '"')
                            then trim(replace(substr(x, 2, length(x) - 2), '""', '"')) else x end)
        end as items from k),
f as (select id, tag, list_filter(list_transform(items, lambda x: trim(x, e' \t\n\r')), lambda x: x <> '') as items from l)
select id, tag, cast(unnest(range(1, len(items) + 1)) as integer) as pos, unnest(items) as item from f
"""


# Hours east of UTC of abbreviations.
HOURS = {"UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5,
         "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5,
         "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9,
         "AKDT": -8, "HST": -10}
_OFFSETS = ", ".join(f"('{k}', {int(v * 3600)})" for k, v in HOURS.items())
_CLOCKS = ["%H:%M:%S", "%H:%M"]
_DAYS = ["%Y:%m:%d", "%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%d %b %Y", "%d %B %Y"]
_PARSED = [f"{d} {c}" for d in _DAYS for c in _CLOCKS] + ["%Y%m%dT%H%M%S", "%Y%m%dT%H%M", "%a %b %d %H:%M:%S %Y"]
_PARSED += [f"{m} %d{comma} %Y{other} {c} %p" for m in ("%b", "%B") for comma in (",", "") for other in (",", "") for c in ("%I:%M", "%I:%M:%S")]
_STRPTIME = "[" + ", ".join(_quoted(f) for f in _PARSED) + "]"
_ZONED = r"(Z|UTC|GMT|[A-Z]{2,4}T|MSK|[+−-][0-9]{2}(?::?[0-9]{2})?|\[[^\]]+\]|[A-Za-z]+/[A-Za-z_/+-]+)$"

P1_FOUND = rf"""
with {ENTRIES},
abbreviations(word, seconds) as (values {_OFFSETS}),
zones as (select folder_id, min(zone_name) as zone_name from folder_zones group by 1),
registered as (select f.path, z.zone_name from indexed_folders f left join zones z on z.folder_id = f.id),
homes as (select o.id, arg_max(r.zone_name, length(r.path)) as zone from o join registered r
          on starts_with(o.path, r.path || '/') or starts_with(o.path, r.path || '\') group by 1),
c as (select e.id, e.tag, name, trim(value) as v, h.zone as home,
             case name when 'DateTimeOriginal' then {_sibling("OffsetTimeOriginal")}
                       when 'ModifyDate' then {_sibling("OffsetTime")} when 'GPSDateTime' then 'UTC' end as own
      from e left join homes h on h.id = e.id
      where name in ('DateTimeOriginal', 'CreateDate', 'ModifyDate', 'DateCreated', 'CreationTime', 'GPSDateTime')),
s as (select *, case when regexp_matches(v, '[0-9]{{2}}:?[0-9]{{2}}([.,][0-9]*)?( ?[AaPp][Mm])? *' || '{_ZONED}')
                     then regexp_extract(v, '{_ZONED}', 1) else '' end as z from c),
t as (select *, regexp_replace(regexp_replace(regexp_replace(trim(left(v, length(v) - length(z))), '([0-9])[.,][0-9]*$', '\1'),
                '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*, +', ''), '([0-9])[T ]+([0-9]{{1,2}}:)', '\1 \2') as body from s),
d as (select *, try_strptime(regexp_replace(regexp_replace(body, '([0-9]) ?([AaPp])[Mm]$', '\1 \2M'), ' +', ' ', 'g'), {_STRPTIME}) as local0 from t),
l as (select id, tag, local0 as local, translate(coalesce(nullif(z, ''), nullif(trim(own), ''), home), '−:[]', '-') as zone
      from d where local0 is not null and year(local0) between 1800 and 2199),
w as (select l.*, case when regexp_matches(zone, '^[+-][0-9]{{2}}([0-9]{{2}})?$')
             then (case when zone[1] = '-' then -1 else 1 end) * (cast(substr(zone, 2, 2) as integer) * 3600
                  + coalesce(try_cast(substr(zone, 4, 2) as integer), 0) * 60) else a.seconds end as shift
      from l left join abbreviations a on a.word = upper(l.zone)),
g as (select *, case when shift is null then cast(epoch(timezone(zone, local)) as bigint) end as usual from w),
instants as (
  select id, tag, case when shift is not null then cast(epoch(local) as bigint) - shift
       when timezone(zone, to_timestamp(usual - 3600)) = local then usual - 3600
       when timezone(zone, to_timestamp(usual - 1800)) = local then usual - 1800 else usual end as utc_second from g
  union all select id, tag, cast(v as bigint) from c where regexp_full_match(v, '[0-9]{{10}}') and cast(v as bigint) > 0
  union all select id, tag, cast(v as bigint) // 1000 from c where regexp_full_match(v, '[0-9]{{13}}') and cast(v as bigint) > 0
  union all select id, 'mtime', cast(floor(case when mtime < 1e11 then mtime when mtime < 1e14 then mtime / 1e3
       when mtime < 1e16 then mtime / 1e6 else mtime / 1e7 - 11644473600 end) as bigint) from images where mtime is not null)
select id, tag, utc_second from instants
"""

SQL = {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND}

"""SQL twins of the general data-preparation queries."""

from darkslide.queries import sql_entries

P5_FOUND = """
with images as (
  select snapshot_no, path, mtime, size,
         row_number() over (partition by snapshot_no, path
                            order by delivered_at desc, mtime desc nulls last, size desc nulls last) as rn
  from image_snapshots where snapshot_no is not null and path is not null
), i as (select snapshot_no, path, mtime, size from images where rn = 1),
is_ as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) as next
        from (select distinct snapshot_no from i)),
i_old as (select is_.next as snapshot_no, i.path, i.mtime, i.size from i join is_ on i.snapshot_no = is_.snapshot_no
          where is_.next is not null),
i_new as (select i.* from i where snapshot_no > (select min(snapshot_no) from i)),
i_diff as (
  select coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(n.path, o.path) as path,
         case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change_kind,
         o.path is not null and n.path is not null and n.mtime is not distinct from o.mtime
           and n.size is not distinct from o.size as same
  from i_new n full join i_old o on n.snapshot_no = o.snapshot_no and n.path = o.path),
folders as (
  select *, row_number() over (partition by snapshot_no, path
     order by delivered_at desc, display_name desc nulls last, enabled desc nulls last, recursive desc nulls last,
              status desc nulls last, image_count desc nulls last, last_scanned_at desc nulls last,
              error_message desc nulls last) as rn
  from folder_snapshots where snapshot_no is not null and path is not null
), f as (select snapshot_no, path, display_name, enabled, recursive, status, image_count, last_scanned_at,
                error_message from folders where rn = 1),
fs_ as (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) as next
        from (select distinct snapshot_no from f)),
f_old as (select fs_.next as at_, f.* from f join fs_ on f.snapshot_no = fs_.snapshot_no where fs_.next is not null),
f_new as (select f.* from f where snapshot_no > (select min(snapshot_no) from f)),
f_diff as (
  select coalesce(n.snapshot_no, o.at_) as snapshot_no, coalesce(n.path, o.path) as path,
         case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change_kind,
         o.path is not null and n.path is not null
           and n.display_name is not distinct from o.display_name and n.enabled is not distinct from o.enabled
           and n.recursive is not distinct from o.recursive and n.status is not distinct from o.status
           and n.image_count is not distinct from o.image_count
           and n.last_scanned_at is not distinct from o.last_scanned_at
           and n.error_message is not distinct from o.error_message as same
  from f_new n full join f_old o on n.snapshot_no = o.at_ and n.path = o.path)
select 'image' as entity, snapshot_no, path, change_kind from i_diff where not same
union all
select 'folder' as entity, snapshot_no, path, change_kind from f_diff where not same
"""

_P6_FORCE = r"""
with listed as (select distinct m.image_id, t.column_name, t.value_type, m.recorded_at,
                       regexp_replace(m.tag_value, '^[\s ]+|[\s ]+$', '', 'g') as v
                from image_metadata m join tag_types t on m.tag = t.tag where m.image_id is not null),
forced as (select image_id, column_name, value_type, v from listed where v <> ''
           qualify row_number() over (partition by image_id, column_name
                                      order by recorded_at desc nulls last, v desc) = 1),
typed as (
  select image_id, column_name, value_type, v,
    case when regexp_full_match(v, '[+-]?[0-9]+([.]0*)?')
         then try_cast(regexp_extract(v, '^[+]?(-?[0-9]+)', 1) as bigint) end as as_bigint,
    case when regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
         then try_cast(ltrim(v, '+') as double)
         when regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)\s*/\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)')
         then try_cast(ltrim(split_part(v, '/', 1), '+') as double)
              / nullif(try_cast(ltrim(split_part(v, '/', 2), '+') as double), 0) end as as_double,
    case when lower(v) in ('1', 'true', 'yes') then true when lower(v) in ('0', 'false', 'no') then false
         end as as_boolean,
    case when regexp_full_match(v, '[0-9]{4}:[0-9]{1,2}:[0-9]{1,2}([ T].*)?|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?')
         then try_cast(replace(regexp_extract(v, '^[0-9]{4}[:-][0-9]{1,2}[:-][0-9]{1,2}'), ':', '-') as date)
         end as as_date
  from forced)
"""

P6_FOUND = (
    _P6_FORCE
    + """
select image_id, column_name from typed
where (value_type = 'bigint' and as_bigint is null) or (value_type = 'double' and as_double is null)
   or (value_type = 'boolean' and as_boolean is null) or (value_type = 'date' and as_date is null)
"""
)

# The columns of tag_types and their types.
WIDE_COLUMNS = [
    ("color_temp", "bigint"),
    ("exposure_bias", "double"),
    ("f_number", "double"),
    ("flash_fired", "boolean"),
    ("gps_speed", "double"),
    ("height", "bigint"),
    ("iso", "bigint"),
    ("lens", "string"),
    ("make", "string"),
    ("marked", "boolean"),
    ("model", "string"),
    ("orientation", "bigint"),
    ("rating", "bigint"),
    ("scan_date", "date"),
    ("software", "string"),
    ("width", "bigint"),
]

P6_WIDE = (
    _P6_FORCE
    + "select image_id, "
    + ", ".join(
        f"max({'v' if t == 'string' else 'as_' + t}) filter (where column_name = '{c}') as {c}"
        for c, t in WIDE_COLUMNS
    )
    + " from typed group by image_id"
)

SQL = {**sql_entries.SQL, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_wide": P6_WIDE}

"""Queries of the general data-processing problems, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import copies, profile, rejects, snapshots


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_events(_table(spark, sf_dir, "csv_lines").filter("line_no > 1")))


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.accepted(rejects.parse_events(_table(spark, sf_dir, "csv_lines").filter("line_no > 1")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.replay(_table(spark, sf_dir, "snapshots"))


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old and new values of p3_found's changed paths."""
    return snapshots.replay_values(_table(spark, sf_dir, "snapshots"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _table(spark, sf_dir, "inventory_primary"), _table(spark, sf_dir, "inventory_replica")
    return copies.compare_copies(left, right, ["vol_name", "path"], {"size": "size", "sha256": "lower(sha256)"}, "seen_at", ("primary", "replica"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shifted_loads(_table(spark, sf_dir, "event_log"))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["occurred_on", "event", "duration_ms", "success", "status"]
    found = profile.profile_loads(_table(spark, sf_dir, "event_log"), ["feed", "load_no"], "load_no", fields, {"occurred_on": "date", "duration_ms": "number"})
    return found.withColumns({"dominant_masks": F.array_join("dominant_masks", "|"), "rare_share": F.round("rare_share", 6), "mask_shift": F.round("mask_shift", 6)})


def p5_rare_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks that p5_profile's rare_share is made of, and those of single values in small loads."""
    return profile.rare_masks(_table(spark, sf_dir, "event_log"), ["feed", "load_no"], ["occurred_on", "event", "duration_ms", "success", "status"])


QUERIES = {f.__name__: f for f in (p1_found, p1_events, p3_found, p3_values, p4_found, p5_found, p5_profile, p5_rare_masks)}

_FIELD = r'("(?:[^"]|"")*"|(?:[^",][^,]*)?)'
_P1 = rf"""
with rec as (
  select line_id, regexp_replace(raw_line, '(\r\n|\n|\r)\z', '') as r from csv_lines where line_no > 1
), shaped as (
  select line_id, r, regexp_full_match(r, '(?s){_FIELD}(,{_FIELD})*') as quoted_well,
    regexp_full_match(r, '(?s){_FIELD}(,{_FIELD}){{4}}') as five from rec
), fields as (
  select line_id, quoted_well, five, list_transform([
    regexp_extract(r, '(?s)\A{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}\z', 1), regexp_extract(r, '(?s)\A{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}\z', 2),
    regexp_extract(r, '(?s)\A{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}\z', 3), regexp_extract(r, '(?s)\A{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}\z', 4),
    regexp_extract(r, '(?s)\A{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}\z', 5)],
    lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as f from shaped
), judged as (
  select *, f[2] = '' or (regexp_full_match(f[2], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and f[2][1:4] <> '0000' and try_cast(f[2] as date) is not null) as day_ok,
    f[4] = '' or (regexp_full_match(f[4], '[ \t\r\n\f\v]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n\f\v]*')
      and coalesce(isfinite(try_cast(regexp_replace(f[4], '[ \t\r\n\f\v]', '', 'g') as double)), false)) as number_ok,
    f[5] in ('', 'true', 'false') as truth_ok from fields
)
"""

ORACLE = {
    "p1_found": _P1
    + """
select line_id, 'quoting' as reason from judged where not quoted_well
union all select line_id, 'width' from judged where quoted_well and not five
union all select line_id, 'occurred_on' from judged where five and not day_ok
union all select line_id, 'duration_ms' from judged where five and not number_ok
union all select line_id, 'success' from judged where five and not truth_ok""",
    "p1_events": _P1
    + """
select line_id as source_key, f[1] as id, case when f[2] <> '' then cast(f[2] as date) end as occurred_on, f[3] as event,
  case when f[4] <> '' then cast(trim(f[4], e' \\t\\r\\n') as double) end as duration_ms, case when f[5] <> '' then f[5] = 'true' end as success
from judged where five and day_ok and number_ok and truth_ok""",
    "p3_found": """
with held as (
  select root_name, snapshot_no, path, size, sha256 from snapshots
  qualify row_number() over (partition by root_name, snapshot_no, path order by recorded_at desc, size desc, sha256 desc) = 1
), steps as (
  select root_name, snapshot_no, lag(snapshot_no) over (partition by root_name order by snapshot_no) as prior
  from (select distinct root_name, snapshot_no from snapshots)
), new_rows as (
  select h.*, s.prior from held h join steps s using (root_name, snapshot_no) where s.prior is not null
), old_rows as (
  select h.root_name, s.snapshot_no, h.path, h.size, h.sha256 from held h join steps s on s.root_name = h.root_name and s.prior = h.snapshot_no
)
select coalesce(n.root_name, o.root_name) as root_name, coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(n.path, o.path) as path,
  case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change_kind
from new_rows n full join old_rows o on n.root_name = o.root_name and n.snapshot_no = o.snapshot_no and n.path = o.path
where o.path is null or n.path is null or n.size is distinct from o.size or n.sha256 is distinct from o.sha256""",
    "p4_found": """
with a as (select vol_name, path, size, lower(sha256) as sha256 from inventory_primary
    qualify row_number() over (partition by vol_name, path order by seen_at desc nulls last, size desc nulls last, lower(sha256) desc nulls last) = 1),
  b as (select vol_name, path, size, lower(sha256) as sha256 from inventory_replica
    qualify row_number() over (partition by vol_name, path order by seen_at desc nulls last, size desc nulls last, lower(sha256) desc nulls last) = 1),
  j as (select coalesce(a.vol_name, b.vol_name) as vol_name, coalesce(a.path, b.path) as path, a.path is null as no_a, b.path is null as no_b,
    a.size is distinct from b.size as d_size, a.sha256 is distinct from b.sha256 as d_sha
    from a full join b on a.vol_name = b.vol_name and a.path = b.path)
select vol_name, path, 'missing_in_replica' as finding from j where no_b
union all select vol_name, path, 'missing_in_primary' from j where no_a
union all select vol_name, path, 'size' from j where not no_a and not no_b and d_size
union all select vol_name, path, 'sha256' from j where not no_a and not no_b and d_sha""",
    "p5_found": r"""
with typed as (
  select feed, load_no, occurred_on, duration_ms, status,
    case when regexp_full_match(occurred_on, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and occurred_on[1:4] <> '0000' then datediff('day', date '1970-01-01', try_cast(occurred_on as date)) end as d,
    case when regexp_full_match(duration_ms, '[ \t\n\v\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\v\f\r]*')
      then try_cast(regexp_replace(duration_ms, '[ \t\n\v\f\r]', '', 'g') as double) end as m0 from event_log
), log as (select *, case when isfinite(m0) then m0 end as m from typed),
loads as (
  select feed, load_no, count(*) as n, count(*) - count(occurred_on) as dn, count(*) - count(duration_ms) as mn, count(*) - count(status) as sn,
    count(*) filter (occurred_on <> '' and d is null) as dx, count(*) filter (duration_ms <> '' and m is null) as mx,
    quantile_disc(d, 0.5) as dm, quantile_disc(m, 0.5) as mm, count(status) as sk
  from log group by all
), steps as (
  select l.*, lag(load_no) over w as p, lag(n) over w as n2, lag(dn) over w as dn2, lag(mn) over w as mn2, lag(sn) over w as sn2, lag(dx) over w as dx2,
    lag(mx) over w as mx2, lag(dm) over w as dm2, lag(mm) over w as mm2, lag(sk) over w as sk2
  from loads l window w as (partition by feed order by load_no)
), shares as (select feed, load_no, status, count(*) as c from log where status is not null group by all),
both_loads as (
  select s.feed, s.load_no, s.sk, s.sk2, h.status, h.c, 0 as c2 from steps s join shares h using (feed, load_no) where s.p is not null
  union all select s.feed, s.load_no, s.sk, s.sk2, h.status, 0, h.c from steps s join shares h on h.feed = s.feed and h.load_no = s.p
), moved as (select feed, load_no, sk, sk2, status, sum(c) as c, sum(c2) as c2 from both_loads group by all)
select feed, load_no, 'occurred_on' as field_name from steps where p is not null and (abs(dn * n2 - dn2 * n) * 100 > 10 * n * n2
  or (n > dn and n2 > dn2 and abs(dx * (n2 - dn2) - dx2 * (n - dn)) * 100 > 10 * (n - dn) * (n2 - dn2)) or dm < dm2 or dm > dm2 + 30)
union all select feed, load_no, 'duration_ms' from steps where p is not null and (abs(mn * n2 - mn2 * n) * 100 > 10 * n * n2
  or (n > mn and n2 > mn2 and abs(mx * (n2 - mn2) - mx2 * (n - mn)) * 100 > 10 * (n - mn) * (n2 - mn2)) or mm > 1.5 * mm2 or mm2 > 1.5 * mm)
union all select feed, load_no, 'status' from (
  select feed, load_no from steps where p is not null and abs(sn * n2 - sn2 * n) * 100 > 10 * n * n2
  union select feed, load_no from moved where sk > 0 and sk2 > 0 and abs(c * sk2 - c2 * sk) * 100 > 15 * sk * sk2)""",
}
ORACLE["stream_rejects"] = ORACLE["p1_found"]

_NUMBER = r"regexp_full_match(value, '[ \t\n\v\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\v\f\r]*')"
ORACLE["p5_profile"] = (
    "with v as ("
    + " union all ".join(f"select feed, load_no, '{f}' as field_name, {f} as value from event_log" for f in ("occurred_on", "event", "duration_ms", "success", "status"))
    + rf"""), j as (
  select *, case when field_name = 'occurred_on' and regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and value[1:4] <> '0000' then cast(datediff('day', date '1970-01-01', try_cast(value as date)) as double)
    when field_name = 'duration_ms' and {_NUMBER} and isfinite(try_cast(regexp_replace(value, '[ 	

]', '', 'g') as double)) then try_cast(regexp_replace(value, '[ 	

]', '', 'g') as double) end as number,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '\p{{Lu}}', 'A', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]', 'a', 'g'), '99+', '9+', 'g'), 'aa+', 'a+', 'g'), 'AA+', 'A+', 'g') as mask from v
), s as (
  select feed, load_no, field_name, count(*) as rows, count(*) - count(value) as nulls, count(distinct value) as distinct_values, min(value) as least_value, max(value) as greatest_value, min(number) as least_number, max(number) as greatest_number,
    count(*) filter (field_name in ('occurred_on', 'duration_ms') and value <> '' and number is null) as off_form, quantile_disc(number, 0.5) as median from j group by all
), m as (select feed, load_no, field_name, mask, count(*) as n, min(value) as example from j where value is not null group by all),
  t as (select feed, load_no, field_name, sum(n) as total from m group by all),
  sh as (select m.*, n / total as share from m join t using (feed, load_no, field_name)),
  o as (select feed, load_no, field_name, coalesce(string_agg(mask, '|' order by mask) filter (share >= 0.2), '') as dominant_masks, round(sum(case when share < 0.01 then share else 0 end), 6) as rare_share from sh group by all),
  nx as (select *, lead(load_no) over w as following, lag(load_no) over w as prior from t window w as (partition by feed, field_name order by load_no)),
  g as (select feed, load_no, field_name, mask, abs(sum(share)) as gap from (select feed, load_no, field_name, mask, share from sh
    union all select sh.feed, following, sh.field_name, mask, -share from sh join nx on nx.feed = sh.feed and nx.load_no = sh.load_no and nx.field_name = sh.field_name where following is not null) group by all),
  gs as (select g.feed, g.load_no, g.field_name, round(sum(gap) / 2, 6) as mask_shift from g join nx on nx.feed = g.feed and nx.load_no = g.load_no and nx.field_name = g.field_name where prior is not null group by all)
select s.*, dominant_masks, rare_share, mask_shift from s left join o using (feed, load_no, field_name) left join gs using (feed, load_no, field_name)"""
)
ORACLE["p5_rare_masks"] = ORACLE["p5_profile"].rsplit("select s.*", 1)[0] + "select feed, load_no, field_name, mask, n, example from sh where share < 0.01 or (n = 1 and share < 0.2)"
ORACLE["p3_values"] = (
    ORACLE["p3_found"].rsplit("select coalesce(n.root_name", 1)[0]
    + """select n.root_name, n.snapshot_no, n.path, o.size as old_size, o.sha256 as old_sha256, n.size as new_size, n.sha256 as new_sha256
from new_rows n join old_rows o on n.root_name = o.root_name and n.snapshot_no = o.snapshot_no and n.path = o.path where n.size is distinct from o.size or n.sha256 is distinct from o.sha256"""
)

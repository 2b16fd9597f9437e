"""Queries of the audits over the given tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import catalogrules, csvrules, issues, jsonlrules, manifest, rejects, textrules, ziprules
from auditframe.operators.csvrules import CsvRules
from auditframe.operators.jsonlrules import JsonlRules
from auditframe.operators.textrules import TextRules
from auditframe.operators.ziprules import ZipRules
from auditframe.runtime import own_folder, spread, written
from auditframe.sources import readers
from auditframe.sources.lines import numbered_lines
from auditframe.streaming import rules as streaming

QUERIES, ORACLE = {}, {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inventories -----------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tex"))
    return manifest.manifest(_table(spark, sf_dir, "documents"), path, F.col("text"))


def _inventory(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One row for each path: the latest seen."""
    latest = F.max(F.struct("seen_at", "size", "sha256")).alias("v")
    rows = _table(spark, sf_dir, name).select(F.concat("vol_name", F.lit("/"), "path").alias("path"), "seen_at", "size", F.lower("sha256").alias("sha256"))
    return rows.groupBy("path").agg(latest).select("path", "v.size", "v.sha256")


_M = "m as (select coalesce(source, 'none') || '/' || doc_id || '.tex' as path, octet_length(encode(text)) as size, sha256(text) as sha256 from documents)"
_SIDE = "(select vol_name || '/' || path as path, size, lower(sha256) as sha256 from inventory_{0} qualify row_number() over (partition by vol_name, path order by seen_at desc nulls last, size desc nulls last, lower(sha256) desc nulls last) = 1)"
_DIFF = f"""d as (select coalesce(b.path, a.path) as path,
  case when b.path is null then 'added' when a.path is null then 'removed' when b.size is not distinct from a.size and b.sha256 is not distinct from a.sha256 then 'unchanged' else 'modified' end as change,
  b.size as before_size, b.sha256 as before_sha256, a.size as after_size, a.sha256 as after_sha256
  from {_SIDE.format("primary")} b full join {_SIDE.format("replica")} a on a.path = b.path)"""
_GROUPS = "g as (select size, sha256, count(*) as files, size * (count(*) - 1) as reclaimable_bytes from m where size >= {0} group by size, sha256 having count(*) > 1)"


@_query(f"with {_M} select * from m")
def manifest_build(spark, sf_dir):
    return _documents(spark, sf_dir)


@_query(f"with {_M} select * from m where not (path like '%3.tex' or path like '%/9_.tex' or split_part(path, '/', 1) = 'openshelf')")
def manifest_exclude(spark, sf_dir):
    return manifest.without_excluded(_documents(spark, sf_dir), ["*3.tex", "*/9?.tex", "openshelf"])


@_query(f"with {_M} select path, size, sha256 from m")
def manifest_component_sort(spark, sf_dir):
    return manifest.in_component_order(_documents(spark, sf_dir))


_FAULTS = r"""with e as (select entry_id as idx, @PATH as path, size, sha256, row_number() over (partition by @PATH order by entry_id) as nth, string_split(@PATH, '/') as parts from intake),
f as (select idx, case when path is null or path = '' then 'invalid_path'
  when contains(path, '\') or list_contains(parts, '') or list_contains(parts, '.') or list_contains(parts, '..') then 'not_normalized' when nth > 1 then 'duplicate_path'
  when size is null or size < 0 then 'invalid_size' when sha256 is null or not regexp_full_match(sha256, '[0-9a-f]{64}') then 'invalid_digest' end as fault from e)
select * from f where fault is not null"""


@_query(_FAULTS.replace("@PATH", "path"))
def manifest_validate(spark, sf_dir):
    return manifest.faults(_table(spark, sf_dir, "intake").withColumnRenamed("entry_id", "idx"))


_ODD_PATH = r"case entry_id % 11 when 0 then '' when 1 then 'a//b' when 2 then null when 3 then '../x' when 4 then concat('same/', entry_id % 3) when 5 then 'a/./b' when 6 then 'a\b' when 7 then '/a' else path end"


@_query(_FAULTS.replace("@PATH", _ODD_PATH))
def manifest_odd_paths(spark, sf_dir):
    """Entries of which many have an unusual or repeated path, put in by rule."""
    return manifest.faults(_table(spark, sf_dir, "intake").select(F.col("entry_id").alias("idx"), F.expr(_ODD_PATH.replace("\\", "\\\\")).alias("path"), "size", "sha256"))


@_query(f"with {_M}, n as (select case when path like '%1.tex' then 'x/.git/' || path when path like '%2.tex' then '__pycache__/' || path when path like '%3.tex' then 'a.git/' || path else path end as path, size, sha256 from m) select * from n where path not like 'x/.git/%' and path not like '\\_\\_pycache\\_\\_/%' escape '\\'")
def manifest_excluded_names(spark, sf_dir):
    """Paths with components that an inventory leaves out by default, put in by rule."""
    path = F.col("path")
    prefix = F.when(path.endswith("1.tex"), "x/.git/").when(path.endswith("2.tex"), "__pycache__/").when(path.endswith("3.tex"), "a.git/").otherwise("")
    return manifest.without_excluded(_documents(spark, sf_dir).withColumn("path", F.concat(prefix, path)))


@_query("with p as (select distinct vol_name || '/' || path as path from inventory_primary), f as (select path, regexp_extract(path, '(?s)\\A(.*)/', 1) as folder from p) select folder, path, row_number() over (partition by folder order by string_split(path, '/')) as place from f")
def manifest_places(spark, sf_dir):
    """The place of each path among those of its folder, in the order of components."""
    paths = _table(spark, sf_dir, "inventory_primary").select(F.concat("vol_name", F.lit("/"), "path").alias("path")).distinct()
    return manifest.component_ranks(paths.withColumn("folder", F.regexp_extract("path", r"(?s)\A(.*)/", 1)), "folder")


@_query(f"with {_DIFF} select * from d where change <> 'unchanged'")
def manifest_diff(spark, sf_dir):
    return manifest.difference(_inventory(spark, sf_dir, "inventory_primary"), _inventory(spark, sf_dir, "inventory_replica"))


@_query(f"with {_DIFF} select count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed, count(*) filter (change = 'modified') as modified, count(*) filter (change = 'unchanged') as unchanged from d")
def manifest_diff_summary(spark, sf_dir):
    return manifest.difference_summary(_inventory(spark, sf_dir, "inventory_primary"), _inventory(spark, sf_dir, "inventory_replica"))


@_query(f"with {_DIFF} select path, change from d")
def manifest_verify(spark, sf_dir):
    """The replica against the primary, the replica also holding the manifest's own file."""
    own = spark.createDataFrame([("manifest.json", 2, "0" * 64)], "path string, size bigint, sha256 string")
    current = _inventory(spark, sf_dir, "inventory_replica").unionByName(own)
    return manifest.verified(_inventory(spark, sf_dir, "inventory_primary"), current, "manifest.json").select("path", "change")


@_query(f"with {_M}, {_GROUPS.format(1)} select sha256, size, files, reclaimable_bytes, path from m join g using (size, sha256)")
def manifest_duplicates(spark, sf_dir):
    return manifest.duplicate_files(_documents(spark, sf_dir)).orderBy(F.desc("reclaimable_bytes"), F.desc("size"), "sha256", "path")


@_query(f"with {_M}, {_GROUPS.format(3000)} select sha256, size, files, reclaimable_bytes from g")
def manifest_duplicates_minsize(spark, sf_dir):
    return manifest.duplicate_groups(_documents(spark, sf_dir), 3000)


@_query(f"with {_M}, {_GROUPS.format(1)} select (select count(*) from m) as scanned_files, (select count(*) from m where size >= 1) as eligible_files, count(*) as duplicate_groups, coalesce(sum(files), 0) as duplicate_files, coalesce(sum(reclaimable_bytes), 0) as reclaimable_bytes from g")
def manifest_duplicates_summary(spark, sf_dir):
    return manifest.duplicate_summary(_documents(spark, sf_dir))


_POLICY = {"version": 1, "max_files": 100, "max_total_bytes": 10_000, "max_file_bytes": 20_000, "required_paths": ["LICENSE", "openshelf/README"], "forbidden_patterns": ["openshelf", "*7.tex"]}


@_query(f"with {_M} select count(*) as files, sum(size) as total_bytes, max(size) as largest_file_bytes from m")
def policy_totals(spark, sf_dir):
    return manifest.policy_totals(_documents(spark, sf_dir))


@_query(
    f"""with {_M}, t as (select count(*) as files, sum(size) as total, max(size) as largest from m)
select 0 as rule_ord, 'max_files' as rule, null as path, files as actual, 100 as maximum, null as patterns from t where files > 100
union all select 1, 'max_total_bytes', null, total, 10000, null from t where total > 10000
union all select 2, 'max_file_bytes', null, largest, 20000, null from t where largest > 20000
union all select 3, 'required_path', p, null, null, null from (values ('LICENSE'), ('openshelf/README')) v(p) where p not in (select path from m)
union all select 4, 'forbidden_pattern', path, null, null, concat_ws('|', case when path like '%7.tex' then '*7.tex' end, case when split_part(path, '/', 1) = 'openshelf' then 'openshelf' end) from m
  where path like '%7.tex' or split_part(path, '/', 1) = 'openshelf'"""
)
def policy_violations(spark, sf_dir):
    return manifest.policy_violations(_documents(spark, sf_dir), _POLICY).withColumn("patterns", F.array_join("patterns", "|"))


@_query(f"with {_M} select path, size from m where size > 20000")
def policy_oversize(spark, sf_dir):
    return manifest.oversize_files(_documents(spark, sf_dir), 20_000)


# ---- CSV -------------------------------------------------------------------------------------

_CSV = CsvRules(("id", "event"), ("id", "event"), "id", {"id": "integer", "occurred_on": "date", "duration_ms": "number", "success": "boolean"}, 24)


def _csv_rows(spark: SparkSession, sf_dir: str, raw_line: str = "raw_line") -> DataFrame:
    """The records of csv_lines as rows of their files, parsed once; those with broken quoting have null fields and an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines, raws = (c.to_pylist() for c in batch.columns)
            fields, errors = [], []
            for line, raw in zip(lines, raws):
                try:
                    fields.append(rejects.read_fields(rejects.without_ending(raw or "").lstrip("﻿" if line == 1 else "")))
                    errors.append(None)
                except ValueError as error:
                    fields.append(None)
                    errors.append(str(error))
            records = pa.array(lines, pa.int64())
            columns = [pa.array(names, pa.string()), pa.array([x - 1 for x in lines], pa.int64()), records, pa.array(fields, pa.list_(pa.string())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "record", "line", "fields", "error"])

    raw = spread(_table(spark, sf_dir, "csv_lines").select("file_name", "line_no", F.expr(raw_line).alias("raw_line")))
    return written(raw.mapInArrow(parse, csvrules.ROW_SCHEMA), "csv-rows")


_CSV_SQL = r"""raw as (
  select file_name as file, line_no as line, regexp_replace(case when line_no = 1 then ltrim(raw_line, chr(65279)) else raw_line end, '(\r\n|\n|\r)\z', '') as r from (select file_name, line_no, @RAW as raw_line from csv_lines)
), heads as (select file_name as file, @HEAD as head from csv_lines where line_no = 1
), parsed as (
  select file, line, case when r = '' then [] else list_transform(regexp_extract_all(r || ',', '(?s)("(?:[^"]|"")*"|(?:[^",][^,]*)?),', 1), lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end as f
  from raw where regexp_full_match(r, '(?s)("(?:[^"]|"")*"|(?:[^",][^,]*)?)(,("(?:[^"]|"")*"|(?:[^",][^,]*)?))*')
), data as (select file, line, f, len(f) as n, head from parsed join heads using (file) where line > 1 and head <> 'none'),
broken as (select file, line from raw where line > 1 and (file, line) not in (select file, line from parsed)),
firsts as (select file, f[1] as v, min(line) as first_line from data where n = 5 group by all having count(*) > 1),
found as (
  select file, line, 'blank_row' as code, null as "column", null as first_line from data where n = 0
  union all select file, line, 'row_width', null, null from data where n not in (0, 5)
  union all select file, line, 'empty_required_values', null, null from data where n = 5 and (f[1] = '' or (f[3] = '' and head <> 'other'))
  union all select d.file, line, 'duplicate_unique_value', 'id', first_line from data d join firsts on d.file = firsts.file and d.f[1] = firsts.v and d.line > first_line where n = 5
  union all select file, line, 'field_too_large', ['id', 'occurred_on', 'event', 'duration_ms', 'success'][i], null from data, range(1, 6) as t(i) where n = 5 and octet_length(encode(f[i])) > 24
  union all select file, line, 'invalid_type', 'id', null from data where n = 5 and f[1] <> '' and not regexp_full_match(f[1], '[+-]?[0-9]+')
  union all select file, line, 'invalid_type', 'occurred_on', null from data where n = 5 and f[2] <> ''
    and not coalesce(regexp_full_match(f[2], '[0-9]{4}-[0-9]{2}-[0-9]{2}') and f[2][1:4] <> '0000' and try_cast(f[2] as date) is not null, false)
  union all select file, line, 'invalid_type', 'duration_ms', null from data where n = 5 and head = 'good' and f[4] <> '' and not (
    regexp_full_match(f[4], '[ \t\n\v\f\r]*[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?[ \t\n\v\f\r]*')
    and coalesce(isfinite(try_cast(regexp_replace(f[4], '[_ \t\n\v\f\r]', '', 'g') as double)), false))
  union all select file, line, 'invalid_type', 'success', null from data where n = 5 and f[5] not in ('', 'true', 'false')
  union all select file, line, 'csv_parse_error', null, null from broken
)"""
_C = _CSV_SQL.replace("@RAW", "raw_line").replace("@HEAD", "'good'")


@_query(f"with {_C} select * from found")
def csv_issues(spark, sf_dir):
    return csvrules.csv_issues(_csv_rows(spark, sf_dir), _CSV).select("file", "line", "code", "column", "first_line")


@_query(
    f"""with {_C}, bad as (select distinct file, line from found), rep as (select file, line from found where code = 'duplicate_unique_value')
select d.file, count(*) as data_rows, count(*) filter (bad.line is null) as valid_rows, count(*) filter (bad.line is not null) as invalid_rows, count(*) filter (n = 0) as blank_rows,
  count(rep.line) as duplicate_rows, coalesce(max(case when n = 5 then list_max(list_transform(f, lambda x: octet_length(encode(x)))) end), 0) as maximum_field_bytes
from (select file, line, f, n from data union all select file, line, null, -1 from broken) d left join bad on bad.file = d.file and bad.line = d.line left join rep on rep.file = d.file and rep.line = d.line group by d.file"""
)
def csv_summary(spark, sf_dir):
    return csvrules.csv_summary(_csv_rows(spark, sf_dir), _CSV, alone=True)


_CSV_DIRT = """case when line_no = 1 and line_id % 5 = 0 then '' when line_no = 1 and line_id % 5 = 1 then 'id,occurred_on,event,,success' when line_no = 1 and line_id % 5 = 2 then 'id,occurred_on,name,name,success'
  when line_no > 1 and line_id % 41 = 0 then '' else raw_line end"""
_CSV_HEAD = "case line_id % 5 when 0 then 'none' when 1 then 'short' when 2 then 'other' else 'good' end"


@_query(
    "with " + _CSV_SQL.replace("@RAW", _CSV_DIRT).replace("@HEAD", _CSV_HEAD) + """, heading(head, code, rule_ord) as (values ('none', 'missing_header', 0), ('short', 'empty_header_columns', 1), ('short', 'missing_rule_columns', 4),
  ('other', 'duplicate_header_columns', 2), ('other', 'missing_required_columns', 3), ('other', 'missing_rule_columns', 4))
select file, 0 as pos, rule_ord, 0 as sub_ord, code, null as line from heads join heading using (head)
union all select file, line - 1, case code when 'blank_row' then 0 when 'row_width' then 0 when 'field_too_large' then 1 when 'empty_required_values' then 2 when 'duplicate_unique_value' then 3 when 'invalid_type' then 4 else 9 end,
  case code when 'field_too_large' then list_position(['id', 'occurred_on', 'event', 'duration_ms', 'success'], "column") - 1
    when 'invalid_type' then list_position(['duration_ms', 'id', 'occurred_on', 'success'], "column") - 1 else 0 end, code, line from found join heads using (file)"""
)
def csv_dirty_issues(spark, sf_dir):
    """The same records with faults put in by rule: headers that are missing, repeated, empty or other than the rules', and blank rows; with the order of a report."""
    return csvrules.csv_issues(_csv_rows(spark, sf_dir, _CSV_DIRT), _CSV).select("file", "pos", "rule_ord", "sub_ord", "code", "line")


@_query()
def stream_rejects(spark, sf_dir):
    """p1's rule on the same records read as a stream."""
    return streaming.drained(streaming.rejected_stream(streaming.stream_of(spark, f"{sf_dir}/csv_lines.parquet").filter("line_no > 1")), "stream")


# ---- JSON Lines ------------------------------------------------------------------------------

_JSONL = JsonlRules(("k",), "k", False, 9)
_DIRT = "case when event_id % 13 = 0 then ' ' when event_id % 17 = 0 then concat(props, ' x') when event_id % 19 = 0 then '[1]' when event_id % 23 = 0 then '{\"k\":1,\"k\":2}' when event_id % 29 = 0 then '{\"k\":NaN}' when event_id % 31 = 0 then '{\"j\":1}' else props end"


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as lines of one file for each type, with faults put in by rule."""
    return spread(_table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.expr(_DIRT).alias("content"))


_J = f"""l as (select event_type as file, event_id as line, {_DIRT} as content, case when event_id % 13 = 0 then 'blank_line' when event_id % 17 = 0 then 'invalid_json' when event_id % 19 = 0 then 'non_object_record'
    when event_id % 23 = 0 then 'duplicate_json_key' when event_id % 29 = 0 then 'invalid_json_constant' when event_id % 31 = 0 then 'no_key' else 'good' end as kind from events),
firsts as (select file, json_extract_string(content, '$.k') as v, min(line) as first_line from l where kind = 'good' group by all having count(*) > 1),
found as (select file, line, kind as code, null as first_line from l where kind not in ('good', 'no_key')
  union all select file, line, 'line_too_large', null from l where kind <> 'blank_line' and octet_length(encode(content)) > 9
  union all select file, line, 'missing_required_fields', null from l where kind = 'no_key'
  union all select file, line, 'missing_unique_field', null from l where kind = 'no_key'
  union all select l.file, line, 'duplicate_unique_value', first_line from l join firsts on l.file = firsts.file and json_extract_string(content, '$.k') = firsts.v and line > first_line where kind = 'good')"""


@_query(f"with {_J} select * from found")
def jsonl_issues(spark, sf_dir):
    return jsonlrules.jsonl_issues(_json_lines(spark, sf_dir), _JSONL).select("file", "line", "code", "first_line")


@_query(
    f"""with {_J}, n as (select file, line, count(*) as errors, count(*) filter (code = 'duplicate_unique_value') as reps from found group by all)
select l.file, count(*) as total_lines, count(*) filter (kind = 'blank_line') as blank_lines, count(*) filter (kind in ('good', 'no_key')) as object_records, count(*) filter (kind in ('good', 'no_key') and errors is null) as valid_records,
  count(errors) as invalid_lines, coalesce(sum(reps), 0) as duplicate_records, coalesce(sum(errors), 0) as error_count from l left join n on n.file = l.file and n.line = l.line group by l.file"""
)
def jsonl_summary(spark, sf_dir):
    return jsonlrules.jsonl_summary(_json_lines(spark, sf_dir), _JSONL)


# ---- text ------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("content")))


_TEXT_SQL = r"""base as (select cast(doc_id as varchar) as file, text, octet_length(encode(text)) as byte_count, len(text) - len(replace(text, chr(13) || chr(10), chr(10))) as crlf,
    len(text) - len(replace(text, chr(10), '')) as n, len(text) - len(replace(text, chr(13), '')) as r, text = '' or right(text, 1) in (chr(10), chr(13)) as final from @DOCS),
t as (select file, text, byte_count, crlf as crlf_endings, n - crlf as lf_endings, r - crlf as bare_cr_endings, final, case when text = '' then [] when final then p[1:len(p) - 1] else p end as lines
  from (select *, regexp_split_to_array(text, '\r\n|\r|\n') as p from base)),
ln as (select file, i as line, lines[i] as v, octet_length(encode(lines[i])) as size from t, range(1, len(lines) + 1) as x(i))"""
_T = _TEXT_SQL.replace("@DOCS", "documents")


@_query(
    f"""with {_T}, ls as (select file, count(*) filter (v like '% ' or v like '%' || chr(9)) as trailed, max(size) as most from ln group by file)
select t.file, byte_count, len(lines) as line_count, case when (crlf_endings > 0)::int + (lf_endings > 0)::int + (bare_cr_endings > 0)::int > 1 then 'mixed' when crlf_endings > 0 then 'crlf' when lf_endings > 0 then 'lf'
    when bare_cr_endings > 0 then 'cr' else 'none' end as newline_style, lf_endings, crlf_endings, bare_cr_endings, final as has_final_newline, starts_with(text, chr(65279)) as has_utf8_bom, len(text) - len(replace(text, chr(0), '')) as nul_bytes,
  coalesce(trailed, 0) as trailing_whitespace_lines, coalesce(most, 0) as maximum_line_bytes from t left join ls on ls.file = t.file"""
)
def text_summary(spark, sf_dir):
    return textrules.text_summary(_texts(spark, sf_dir))


_FOUND = """found as (
  select file, 0 as rule_ord, 0 as sub_ord, 'utf8_bom' as code, null as line from t where starts_with(text, chr(65279)) union all select file, 1, 0, 'nul_bytes', null from t where contains(text, chr(0))
  union all select file, 3, 0, 'mixed_newlines', null from t where (crlf_endings > 0)::int + (lf_endings > 0)::int + (bare_cr_endings > 0)::int > 1
  union all select file, 4, 0, 'bare_cr_newline', null from t where bare_cr_endings > 0 union all select file, 5, 0, 'missing_final_newline', null from t where not final
  union all select file, 6, 2 * line - 2, 'trailing_whitespace', line from ln where v like '% ' or v like '%' || chr(9) union all select file, 6, 2 * line - 1, 'line_too_large', line from ln where size > 400)"""
_TI = f"{_T}, {_FOUND}"
_TEXT = TextRules(max_line_bytes=400)


@_query(f"with {_TI} select file, code, line from found")
def text_issues(spark, sf_dir):
    return textrules.text_issues(_texts(spark, sf_dir), _TEXT).select("file", "code", "line")


#: Marks, NULs, bytes that aren't UTF-8, and other newlines, put into the texts by rule. In the SQL, X stands for the wrong byte.
_DIRTY_DOCS = r"""(select doc_id, case doc_id % 7 when 0 then chr(65279) || text when 1 then text[1:10] || chr(0) || text[11:] when 2 then text || 'X' when 3 then replace(text, chr(10), chr(13))
  when 4 then regexp_replace(text, '\n', e'\r\n') else text end as text from documents)"""


@_query(
    f"with {_TEXT_SQL.replace('@DOCS', _DIRTY_DOCS)}, {_FOUND} select file, rule_ord, sub_ord, code, line, null as byte_offset from found union all select cast(doc_id as varchar), 2, 0, 'invalid_utf8', null, octet_length(encode(text)) from documents where doc_id % 7 = 2"
)
def text_dirty_issues(spark, sf_dir):
    """Every code of the text rules, with the order of a report."""
    kind, byte, text = F.col("doc_id") % 7, F.col("text").cast("binary"), F.col("text")
    at = F.instr("text", "\n")
    crlf = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("\r\n"), F.substring(text, at + 1, F.length(text)))).otherwise(text)
    content = (
        F.when(kind == 0, F.concat(F.lit(b"\xef\xbb\xbf"), byte)).when(kind == 1, F.concat(F.substring(text, 1, 10), F.lit("\0"), F.substring(text, F.lit(11), F.length(text))).cast("binary"))
        .when(kind == 2, F.concat(byte, F.lit(b"\xff"))).when(kind == 3, F.translate(text, "\n", "\r").cast("binary")).when(kind == 4, crlf.cast("binary")).otherwise(byte)
    )
    files = spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), content.alias("content")))
    return textrules.text_issues(files, _TEXT).select("file", "rule_ord", "sub_ord", "code", "line", "byte_offset")


@_query(f"with {_TI} select code, count(*) as n from found group by code")
def issue_code_counts(spark, sf_dir):
    return issues.code_counts(textrules.text_issues(_texts(spark, sf_dir), _TEXT))


@_query(f"with {_TI} select file, code, line, row_number() over (partition by file order by rule_ord, sub_ord) as issue_no from found qualify issue_no <= 5")
def issue_topk(spark, sf_dir):
    return issues.reported(textrules.text_issues(_texts(spark, sf_dir), _TEXT), 5, "file").select("file", "code", "line", "issue_no")


# ---- archives and catalogs -------------------------------------------------------------------

_NAME = "case when entry_id % 11 = 0 then concat('../', path) when entry_id % 13 = 0 then concat('/', path) when entry_id % 17 = 0 then replace(path, '/', '\\\\') when entry_id % 19 = 0 then upper(path) when entry_id % 23 = 0 then replace(path, '/', '//') when entry_id % 29 = 0 then concat('C:', path) else path end"

_PACKED = "cast(coalesce(octet_length(body), size, 0) div 40 as bigint)"


def _entries(spark: SparkSession, sf_dir: str, name: str = _NAME, packed: str = _PACKED) -> DataFrame:
    """The intake's batches as archives, with hazards put into some names by rule."""
    return _table(spark, sf_dir, "intake").select(
        F.concat(F.lit("batch-"), F.col("batch_no").cast("string")).alias("archive"), F.col("entry_id").alias("entry_index"), F.expr(name).alias("name"), F.lit(False).alias("is_dir"),
        F.expr(packed).alias("compress_size"), F.expr("cast(coalesce(size, 0) as bigint)").alias("file_size"),
        F.expr("cast(case when entry_id % 37 = 0 then 2717843456 else 0 end as bigint)").alias("external_attr"), F.expr("cast(entry_id % 41 = 0 as int)").alias("flag_bits"),
    )


_ZIP = ZipRules(200_000, 1_000_000, 60.0)
_ZIP_SQL = r"""e as (select 'batch-' || batch_no as archive, entry_id as entry_index, @NAME as name, @PACKED as packed, cast(coalesce(size, 0) as bigint) as size, entry_id from intake),
p as (select *, string_split(regexp_replace(replace(name, '\', '/'), '/\z', ''), '/') as parts from e),
h as (select *, name = '' or contains(name, chr(0)) as h1, regexp_matches(name, '(?s)\A([/\\]|.:)') as h2, contains(name, '\') as h3, list_contains(parts, '..') as h4, list_contains(parts, '') or list_contains(parts, '.') as h5 from p),
s as (select *, array_to_string(parts, '/') as canonical, lower(replace(array_to_string(parts, '/'), 'ß', 'ss')) as folded from h where not (h1 or h2 or h3 or h4 or h5)),
holders as (select archive, folded, first(name order by entry_index) as hname, first(canonical order by entry_index) as hcanon, min(entry_index) as hindex from s group by all having count(*) > 1),
names as (select archive, name, min(entry_index) as first_index from e group by all having count(*) > 1),
found as (
  select archive, entry_index, 'invalid_path' as code, null as first_entry_index from h where h1 union all select archive, entry_index, 'absolute_or_drive_path', null from h where h2
  union all select archive, entry_index, 'backslash_path', null from h where h3 union all select archive, entry_index, 'parent_traversal', null from h where h4 union all select archive, entry_index, 'non_normalized_path', null from h where h5
  union all select e.archive, entry_index, 'duplicate_path', first_index from e join names on names.archive = e.archive and names.name = e.name and entry_index > first_index
  union all select s.archive, entry_index, case when hcanon = canonical then 'normalized_path_collision' else 'case_collision' end, hindex from s join holders on holders.archive = s.archive and holders.folded = s.folded and hname <> name
  union all select archive, entry_index, 'symlink_entry', null from e where entry_id % 37 = 0 union all select archive, entry_index, 'encrypted_entry', null from e where entry_id % 41 = 0
  union all select archive, entry_index, 'entry_too_large', null from e where size > 200000 union all select archive, entry_index, 'compression_ratio_exceeded', null from e where size > 0 and (packed = 0 or size / packed > 60)
  union all select archive, null, 'archive_too_large', null from (select archive, sum(size) as total from e group by archive) where total > 1000000)"""
_PACKED_SQL = "cast(coalesce(octet_length(encode(body)), size, 0) as bigint) // 40"
_Z = _ZIP_SQL.replace("@NAME", _NAME.replace("'\\\\'", "'\\'")).replace("@PACKED", _PACKED_SQL)


@_query(f"with {_Z} select * from found")
def zip_issues(spark, sf_dir):
    return ziprules.zip_issues(_entries(spark, sf_dir), _ZIP).select("archive", "entry_index", "code", "first_entry_index")


@_query(
    f"""with {_Z} select archive, count(*) as entry_count, count(*) as file_count, 0 as directory_count, sum(packed) as total_compressed_bytes, sum(size) as total_uncompressed_bytes, max(size) as largest_entry_uncompressed_bytes,
  round(coalesce(max(case when size > 0 and packed > 0 then size / packed end), 0), 6) as highest_finite_compression_ratio, count(*) filter (size > 0 and packed = 0) as unbounded_compression_ratio_entries from e group by archive"""
)
def zip_summary(spark, sf_dir):
    return ziprules.zip_summary(_entries(spark, sf_dir)).withColumn("highest_finite_compression_ratio", F.round("highest_finite_compression_ratio", 6))


#: Names that are empty, repeated, or the same but for case or a last slash, and sizes that nothing packs to.
_ODD_NAME = "case when entry_id % 31 = 0 then '' when entry_id % 37 = 1 then concat('Straße/', entry_id % 5) when entry_id % 37 = 2 then concat('STRASSE/', entry_id % 5) when entry_id % 37 = 3 then concat('same/', entry_id % 5) when entry_id % 37 = 4 then concat('Same/', entry_id % 5) when entry_id % 37 = 5 then concat('same/', entry_id % 5, '/') else path end"
_ODD_PACKED = "case when entry_id % 29 = 0 then 0 when entry_id % 29 = 1 then size div 1000 else size end"


@_query(
    "with " + _ZIP_SQL.replace("@NAME", _ODD_NAME).replace("@PACKED", "coalesce(" + _ODD_PACKED.replace(" div ", " // ") + ", 0)")
    + """, ranks(code, rule_ord) as (values ('invalid_path', 0), ('absolute_or_drive_path', 1), ('backslash_path', 2), ('parent_traversal', 3), ('non_normalized_path', 4), ('duplicate_path', 5), ('normalized_path_collision', 6), ('case_collision', 6),
  ('symlink_entry', 7), ('encrypted_entry', 8), ('entry_too_large', 9), ('compression_ratio_exceeded', 10), ('archive_too_large', 11))
select archive, coalesce(entry_index, 4611686018427387904) as pos, rule_ord, code, first_entry_index from found join ranks using (code)"""
)
def zip_dirty_issues(spark, sf_dir):
    """Collisions, repeated and empty names, and ratios, with the order of a report."""
    return ziprules.zip_issues(_entries(spark, sf_dir, _ODD_NAME, f"cast(coalesce({_ODD_PACKED}, 0) as bigint)"), _ZIP).select("archive", "pos", "rule_ord", "code", "first_entry_index")


@_query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F')")
def fk_violations(spark, sf_dir):
    """Line items that refer to no order among those not finished."""
    parents = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return catalogrules.orphans(_table(spark, sf_dir, "lineitem"), parents, ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


_CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@_query(
    f"""select table_name as name, count(*) as column_count, count(*) filter (data_type = 'VARCHAR') as hidden_column_count, count(*) filter (column_name like '%key') as not_null_column_count, count(*) filter (ordinal_position = 1) as primary_key_column_count,
  count(*) filter (column_name like '%key' and ordinal_position > 1) as foreign_key_count, count(*) filter (column_name like '%key') as index_count from information_schema.columns where table_name in {_CATALOG} group by all"""
)
def catalog_counts(spark, sf_dir):
    """Counts of the star schema's tables, from catalog rows as the database reader gives them: strings are taken as hidden, keys as indexed, and keys after the first column as references."""
    rows = []
    for name in _CATALOG:
        rows.append(("db", "object", 0, "table", name, name, None, None, None, None, None))
        for i, (column, kind) in enumerate(_table(spark, sf_dir, name).dtypes):
            key = column.endswith("key")
            rows.append(("db", "column", i, None, column, name, int(kind == "string"), int(key), int(i == 0), None, None))
            rows += [("db", "index", i, None, None, name, None, None, None, None, None)] * key + [("db", "foreign_key", i, None, None, name, None, None, None, None, None)] * (key and i > 0)
    return catalogrules.table_counts(spark.createDataFrame(rows, catalogrules.CATALOG_SCHEMA)).drop("db")


# ---- files -----------------------------------------------------------------------------------


def _local(uri: str) -> str:
    """The path of a file in a mounted shared folder, from its address."""
    return uri if uri.startswith("/") else "/" + uri.split(":", 1)[1].lstrip("/")


@_query(f"with {_M} select * from m")
def tree_inventory(spark, sf_dir):
    """The documents laid out as files in the shared folder, listed and hashed by the tree reader."""
    root = _local(own_folder(spark, "tree"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = Path(root, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                # a task that is run again writes the same file, and never half of it
                part = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
                part.write_bytes(content or b"")
                part.replace(target)
            yield batch.select([0])

    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tex"))
    _table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content")).mapInArrow(lay, "path string").write.format("noop").mode("overwrite").save()
    return readers.tree(spark, root)


@_query("select count(*) as data_rows, count(*) filter (c_acctbal >= 0 and c_nationkey <> 3) as valid_rows, count(*) filter (c_acctbal < 0 or c_nationkey = 3) as invalid_rows, 0 as duplicate_rows from customer")
def csv_file_audit(spark, sf_dir):
    """The customers as CSV files with quoted names, in which balances below zero and one nation's keys are written off their form; read by the CSV reader."""
    folder = own_folder(spark, "csv")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"')).alias("name"), F.when(F.col("c_acctbal") < 0, "owed").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(F.col("c_nationkey") == 3, "3.0").otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    rows.write.option("header", True).option("escape", '"').csv(folder)
    paths = [_local(r[0]) for r in spark.read.text(folder).select(F.col("_metadata.file_path").alias("p")).distinct().orderBy("p").collect()]
    rules = CsvRules(("c_custkey", "name"), ("name",), "c_custkey", {"c_custkey": "integer", "balance": "number", "nation": "integer"})
    return csvrules.csv_summary(readers.csv_files(spark, paths), rules).agg(*[F.sum(c).alias(c) for c in ("data_rows", "valid_rows", "invalid_rows", "duplicate_rows")])


@_query(f"with l as (select {_DIRT} as content, event_id from events) select count(*) as total_lines, count(*) filter (event_id % 13 = 0) as blank_lines, count(*) filter (content like '{{%' and content not like '% x' and content not like '%NaN%' and content not like '%k%k%') as object_records from l")
def jsonl_file_audit(spark, sf_dir):
    """The events' properties as files of lines, with faults put in by rule, read with their line numbers."""
    folder = own_folder(spark, "jsonl")
    _table(spark, sf_dir, "events").select(F.expr(_DIRT)).write.text(folder)
    found = jsonlrules.jsonl_summary(numbered_lines(spark, [folder]), JsonlRules(("k",)))
    return found.agg(*[F.sum(c).alias(c) for c in ("total_lines", "blank_lines", "object_records")])

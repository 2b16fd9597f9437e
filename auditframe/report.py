"""Reports on one file or inventory, as dictionaries, from the DataFrame operators."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import config
from auditframe.config import InvalidInventoryError, InvalidPolicyError, Policy, positive_int
from auditframe.operators import catalogrules, csvrules, issues, jsonlrules, manifest, textrules, ziprules
from auditframe.operators.csvrules import CsvRules
from auditframe.operators.jsonlrules import JsonlRules
from auditframe.operators.textrules import TextRules
from auditframe.operators.ziprules import ZipRules
from auditframe.sources import readers
from auditframe.sources.lines import numbered_lines

_ENTRY = "path string, size decimal(38,0), sha256 string"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _inventory(value: Any, source: str = "inventory") -> DataFrame:
    """An inventory given as values or as a DataFrame (path, size, sha256), checked."""
    if isinstance(value, DataFrame):
        bad = manifest.faults(value.withColumn("idx", F.monotonically_increasing_id())).orderBy("idx").first()
        if bad:
            raise InvalidInventoryError(f"{source} entry {bad['idx']}: {bad['fault']}")
        return value
    from decimal import Decimal

    entries = config.inventory_entries(value, source)
    return session().createDataFrame([(e["path"], Decimal(e["size"]), e["sha256"]) for e in entries], _ENTRY)


def _json(path: str | Path, error: type[ValueError]) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as fault:
        raise error(f"{path}: invalid JSON at line {fault.lineno}, column {fault.colno}") from fault


def build_inventory(root: str | Path, excluded_names: set[str] | None = None, *, exclude_patterns: Sequence[str] = ()) -> list[dict[str, Any]]:
    names = manifest.EXCLUDED_NAMES if excluded_names is None else sorted(excluded_names)
    rows = manifest.in_component_order(readers.tree(session(), str(root), exclude_patterns, names)).collect()
    return [r.asDict() for r in rows]


def load_inventory(path: str | Path) -> list[dict[str, Any]]:
    return config.inventory_entries(_json(path, InvalidInventoryError), str(path))


def load_policy(path: str | Path) -> dict[str, Any]:
    return Policy.of(_json(path, InvalidPolicyError)).as_dict()


def _difference(before: DataFrame, after: DataFrame, compared: DataFrame) -> dict[str, Any]:
    report: dict[str, Any] = {"summary": dict.fromkeys(("added", "removed", "modified", "unchanged"), 0), "added": [], "removed": [], "modified": []}
    report["summary"] |= {r["change"]: r["n"] for r in compared.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in compared.filter("change <> 'unchanged'").orderBy("path").toLocalIterator():
        old, new = ({"size": int(r[f"{s}_size"]), "sha256": r[f"{s}_sha256"]} if r[f"{s}_sha256"] is not None else None for s in ("before", "after"))
        report[r["change"]].append({"path": r["path"], "before": old, "after": new} if old and new else {"path": r["path"], **(old or new)})
    return report


def compare_inventories(before: Any, after: Any) -> dict[str, Any]:
    b, a = _inventory(before, "before inventory"), _inventory(after, "after inventory")
    return _difference(b, a, manifest.compared(b, a))


def verify_directory(root: str | Path, manifest_path: str | Path, *, exclude_patterns: Sequence[str] = ()) -> dict[str, Any]:
    root, file = Path(root), Path(manifest_path)
    if not root.is_dir():
        raise ValueError(f"directory does not exist: {root}")
    expected = _inventory(load_inventory(file))
    current = readers.tree(session(), str(root), exclude_patterns).select("path", F.col("size").cast("decimal(38,0)").alias("size"), "sha256")
    inside = file.resolve().relative_to(root.resolve()).as_posix() if file.resolve().is_relative_to(root.resolve()) else None
    return _difference(expected, current, manifest.verified(expected, current, inside))


def find_duplicates(inventory: Any, *, min_size: int = 1) -> dict[str, Any]:
    config.natural("min_size", min_size)
    entries = _inventory(inventory)
    groups: dict[tuple, dict[str, Any]] = {}
    ordered = manifest.duplicate_files(entries, min_size).orderBy(F.desc("reclaimable_bytes"), F.desc("size"), "sha256", "path")
    for r in ordered.toLocalIterator():
        group = groups.setdefault((r["size"], r["sha256"]), {"sha256": r["sha256"], "size": int(r["size"]), "count": r["files"], "reclaimable_bytes": int(r["reclaimable_bytes"]), "paths": []})
        group["paths"].append(r["path"])
    summary = {k: int(v) for k, v in manifest.duplicate_summary(entries, min_size).first().asDict().items()}
    return {"summary": summary, "min_size": min_size, "groups": list(groups.values())}


def audit_inventory_policy(inventory: Any, policy: Any) -> dict[str, Any]:
    entries, policy = _inventory(inventory), Policy.of(policy)
    totals = {k: int(v) for k, v in manifest.policy_totals(entries).first().asDict().items()}
    found = []
    for r in manifest.policy_violations(entries, policy).orderBy("rule_ord", "path").collect():
        violation: dict[str, Any] = {"rule": r["rule"]}
        if r["actual"] is not None:
            violation |= {"actual": int(r["actual"]), "maximum": r["maximum"]}
            if r["rule"] == "max_file_bytes":
                over = manifest.oversize_files(entries, r["maximum"]).orderBy("path").collect()
                violation["offending_files"] = [{"path": o["path"], "size": int(o["size"])} for o in over]
            else:
                violation["excess"] = violation["actual"] - violation["maximum"]
        else:
            violation["path"] = r["path"]
            if r["patterns"] is not None:
                violation["patterns"] = r["patterns"]
        found.append(violation)
    return {"passed": not found, "summary": {**totals, "violations": len(found)}, "policy": policy.as_dict(), "violations": found}


def _plain(value: Any) -> Any:
    from decimal import Decimal

    return int(value) if isinstance(value, Decimal) else value


def _issues(found: DataFrame, details: Mapping[str, Sequence[str]], max_errors: int, key: str) -> tuple[dict[str, int], list[dict[str, Any]]]:
    """Complete counts by code, and the first issues with their codes' details."""
    found = found.cache()
    try:
        counts = {r["code"]: r["n"] for r in issues.code_counts(found).collect()}
        first = issues.reported(found, max_errors, key).orderBy("issue_no").collect()
    finally:
        found.unpersist()
    names = {"positions": "columns"}
    rendered = []
    for r in first:
        shown = [d for d in details.get(r["code"], ()) if not (d == "reason" and r[d] is None)]
        rendered.append({"code": r["code"], **{names.get(d, d): _plain(r[d]) for d in shown}})
    return dict(sorted(counts.items())), rendered


def _counted(counts: Mapping[str, int], shown: list) -> dict[str, Any]:
    total = sum(counts.values())
    return {"issue_count": total, "reported_issues": len(shown), "truncated_issues": total - len(shown), "issue_codes": dict(counts)}


def audit_csv(
    lines: Iterable[str] | str | Path, *, required_columns: Sequence[str] = (), not_empty_columns: Sequence[str] = (), unique_column: str | None = None,
    column_types: Mapping[str, str] | None = None, max_field_bytes: int | None = None, max_errors: int = 100,
) -> dict[str, Any]:
    """A report on one CSV file, given by its path or its physical lines."""
    types = config.column_types(column_types)
    rules = CsvRules(required_columns, not_empty_columns, unique_column, types, max_field_bytes)
    positive_int("max_errors", max_errors)
    spark = session()
    if isinstance(lines, (str, Path)):
        Path(lines).open("rb").close()
        _check_utf8(lines)
        rows = readers.csv_files(spark, [lines])
    else:
        rows = spark.createDataFrame(list(readers.csv_rows("lines", lines)), csvrules.ROW_SCHEMA)
    rows = rows.cache()
    try:
        header = rows.filter("record = 0 and error is null").first()
        error = rows.filter("error is not null").first()
        if header is not None and not header["fields"]:
            error = None
        found = csvrules.csv_issues(rows if header is None or header["fields"] else rows.filter("record = 0"), rules)
        counts, shown = _issues(found, csvrules.DETAILS, max_errors, "file")
        zero = {"data_rows": 0, "valid_rows": 0, "invalid_rows": 0, "blank_rows": 0, "duplicate_rows": 0, "maximum_field_bytes": 0}
        summary = csvrules.csv_summary(rows, rules).first()
        if header is not None and not header["fields"]:
            read = header["line"]
        else:
            read = rows.agg(F.max("line")).first()[0] or 0
    finally:
        rows.unpersist()
    heads = {"missing_header", "empty_header_columns", "duplicate_header_columns", "missing_required_columns", "missing_rule_columns"}
    fields = list(header["fields"]) if header is not None else []
    return {
        "passed": not counts, "header": fields,
        "summary": {
            "header_valid": bool(fields) and not heads & set(counts), "physical_lines_read": read, **({k: summary[k] for k in zero} if summary else zero), "stopped_early": error is not None, **_counted(counts, shown),
        },
        "configuration": {
            "required_columns": list(required_columns), "not_empty_columns": list(not_empty_columns), "unique_column": unique_column, "column_types": dict(sorted(types.items())), "max_field_bytes": max_field_bytes, "max_errors": max_errors,
        },
        "issues": shown,
    }


def _check_utf8(path: str | Path) -> None:
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as handle:
        while chunk := handle.read(1 << 20):
            decoder.decode(chunk)
        decoder.decode(b"", True)


def audit_jsonl(
    lines: Iterable[str] | str | Path, *, required_fields: Sequence[str] = (), unique_field: str | None = None, allow_blank_lines: bool = False, max_line_bytes: int | None = None, max_errors: int = 100
) -> dict[str, Any]:
    """A report on one JSON Lines file, given by its path or its lines."""
    rules = JsonlRules(required_fields, unique_field, allow_blank_lines, max_line_bytes)
    positive_int("max_errors", max_errors)
    spark = session()
    if isinstance(lines, (str, Path)):
        _check_utf8(lines)
        rows = numbered_lines(spark, [lines])
    else:
        given = list(lines)
        for i, line in enumerate(given, 1):
            if not isinstance(line, str):
                raise ValueError(f"line {i} must be a string")
        rows = spark.createDataFrame([("lines", i, line.rstrip("\r\n")) for i, line in enumerate(given, 1)], "file string, line bigint, content string")
    found = jsonlrules.jsonl_issues(rows, rules)
    counts, shown = _issues(found, {code: ("line", *d) for code, d in jsonlrules.DETAILS.items()} | {"unreadable": ("message",)}, max_errors, "file")
    if "unreadable" in counts:
        raise ValueError("a line can't be read: " + next((e["message"] for e in shown if e["code"] == "unreadable"), "number or nesting beyond limits"))
    keys = ("total_lines", "blank_lines", "object_records", "valid_records", "invalid_lines", "duplicate_records", "error_count")
    summary = jsonlrules.jsonl_summary(rows, rules).first()
    summary = {k: summary[k] if summary else 0 for k in keys}
    errors = [{"line": e.pop("line"), **e} for e in shown]
    return {
        "passed": not errors, "summary": {**summary, "reported_errors": len(errors), "truncated_errors": summary["error_count"] - len(errors)},
        "configuration": {"required_fields": list(required_fields), "unique_field": unique_field, "allow_blank_lines": allow_blank_lines, "max_line_bytes": max_line_bytes, "max_errors": max_errors}, "errors": errors,
    }


def audit_text_file(
    path: str | Path, *, max_file_bytes: int = 10 * 1024 * 1024, max_line_bytes: int | None = None, max_errors: int = 100, allow_utf8_bom: bool = False, require_final_newline: bool = True
) -> dict[str, Any]:
    positive_int("max_file_bytes", max_file_bytes)
    rules = TextRules(max_line_bytes, allow_utf8_bom, require_final_newline)
    positive_int("max_errors", max_errors)
    Path(path).open("rb").close()
    files = readers.contents(session(), [path], max_file_bytes).cache()
    try:
        if files.first()["too_large"]:
            raise ValueError(f"file exceeds max_file_bytes ({max_file_bytes})")
        counts, shown = _issues(textrules.text_issues(files, rules), textrules.DETAILS, max_errors, "file")
        summary = textrules.text_summary(files).first().asDict()
    finally:
        files.unpersist()
    summary.pop("file")
    return {
        "passed": not counts, "summary": {**summary, **_counted(counts, shown)},
        "configuration": {"max_file_bytes": max_file_bytes, "max_line_bytes": max_line_bytes, "max_errors": max_errors, "allow_utf8_bom": allow_utf8_bom, "require_final_newline": require_final_newline}, "issues": shown,
    }


def audit_zip(
    archive: str | Path, *, max_entry_uncompressed_bytes: int = 100 * 1024 * 1024, max_total_uncompressed_bytes: int = 1024 * 1024 * 1024, max_compression_ratio: float = 100.0, max_errors: int = 100
) -> dict[str, Any]:
    rules = ZipRules(max_entry_uncompressed_bytes, max_total_uncompressed_bytes, max_compression_ratio)
    positive_int("max_errors", max_errors)
    import zipfile

    zipfile.ZipFile(archive).close()
    entries = readers.zip_entries(session(), [archive]).cache()
    try:
        counts, shown = _issues(ziprules.zip_issues(entries, rules), ziprules.DETAILS, max_errors, "archive")
        summary = ziprules.zip_summary(entries.withColumn("archive", F.lit(""))).first()
    finally:
        entries.unpersist()
    keys = ("entry_count", "file_count", "directory_count", "total_compressed_bytes", "total_uncompressed_bytes", "largest_entry_uncompressed_bytes", "highest_finite_compression_ratio", "unbounded_compression_ratio_entries")
    totals = {k: _plain(summary[k]) if summary else (0.0 if "ratio" in k and "finite" in k else 0) for k in keys}
    return {
        "passed": not counts, "summary": {**totals, **_counted(counts, shown)},
        "configuration": {"max_entry_uncompressed_bytes": max_entry_uncompressed_bytes, "max_total_uncompressed_bytes": max_total_uncompressed_bytes, "max_compression_ratio": float(max_compression_ratio), "max_errors": max_errors}, "issues": shown,
    }


def audit_sqlite(database: str | Path, *, max_errors: int = 100) -> dict[str, Any]:
    positive_int("max_errors", max_errors)
    path = Path(database).resolve(strict=True)
    if not path.is_file():
        raise ValueError("database must be a regular file")
    import sqlite3

    probe = sqlite3.connect(f"{path.as_uri()}?mode=ro", uri=True, timeout=5.0)
    try:
        probe.execute("SELECT count(*) FROM sqlite_schema").fetchone()
    finally:
        probe.close()
    catalog = readers.sqlite_catalogs(session(), [path], max_errors).cache()
    try:
        pragmas = {r["name"]: r["int_value"] if r["text_value"] is None else r["text_value"] for r in catalog.filter("kind = 'pragma'").collect()}
        kinds = {r["type"]: r["n"] for r in catalogrules.object_counts(catalog).collect()}
        tables = [r.asDict() for r in catalogrules.table_counts(catalog).orderBy("name").drop("db").collect()]
        quick = [r["text_value"] for r in catalog.filter("kind = 'quick_check'").orderBy("ord").limit(max_errors + 1).collect()]
        orphans = catalog.filter("kind = 'violation'")
        n_orphans, first = orphans.count(), orphans.orderBy("ord").limit(max_errors).collect()
    finally:
        catalog.unpersist()
    healthy = quick == ["ok"]
    shown = [] if healthy else [{"code": "quick_check_failed", "message": m} for m in quick]
    counts = {"quick_check_failed": len(shown)} if shown else {}
    if n_orphans:
        counts = {"foreign_key_violation": n_orphans} | counts
    shown += [{"code": "foreign_key_violation", "table": r["tbl_name"], "row_id": r["int_value"], "parent_table": r["name"], "constraint_index": r["pk"]} for r in first]
    shown = shown[:max_errors]
    pages = pragmas["page_count"]
    return {
        "passed": not counts,
        "summary": {
            "file_size_bytes": pragmas["file_size"], "page_size_bytes": pragmas["page_size"], "page_count": pages, "freelist_count": pragmas["freelist_count"], "freelist_ratio": pragmas["freelist_count"] / pages if pages else 0.0,
            "user_version": pragmas["user_version"], "application_id": pragmas["application_id"], "encoding": pragmas["encoding"], "object_count": sum(kinds.values()), "object_type_counts": dict(sorted(kinds.items())),
            "table_count": len(tables), "quick_check_ok": healthy, **_counted(counts, shown),
        },
        "configuration": {"max_errors": max_errors}, "tables": tables, "issues": shown,
    }

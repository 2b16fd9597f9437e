"""The reports on single files and inventories."""

import json
import sqlite3
import zipfile

import pytest

import auditframe as af
from auditframe.cli import main

A, B, C, D = (x * 64 for x in "abcd")


def entry(path, digest=A, size=1):
    return {"path": path, "size": size, "sha256": digest}


def codes(report, key="issues"):
    return [x["code"] for x in report[key]]


def test_inventory_of_a_tree(spark, tmp_path):
    for name, text in (("b.txt", "b"), ("a/n.txt", "n"), ("a.txt", ""), ("a-b", "x"), ("_hidden", "h"), (".dot", "d"), (".git/config", "g"), ("x/__pycache__/c", "c"), ("cache/deep/f", "f"), ("x/t.tmp", "t")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = af.build_inventory(tmp_path, exclude_patterns=["*.tmp", "cache"])
    assert [e["path"] for e in found] == [".dot", "_hidden", "a/n.txt", "a-b", "a.txt", "b.txt"]
    assert found[4] == {"path": "a.txt", "size": 0, "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert af.build_inventory(tmp_path / "missing") == []
    for bad in ("", "/abs", "a/../b", "a\\b", ".", "a//b"):
        with pytest.raises(ValueError):
            af.build_inventory(tmp_path, exclude_patterns=[bad])


def test_difference(spark):
    report = af.compare_inventories([entry("same", A), entry("removed", B), entry("changed", C, 2)], [entry("new", D), entry("changed", "e" * 64, 3), entry("same", A)])
    assert report == {
        "summary": {"added": 1, "removed": 1, "modified": 1, "unchanged": 1}, "added": [entry("new", D)], "removed": [entry("removed", B)],
        "modified": [{"path": "changed", "before": {"size": 2, "sha256": C}, "after": {"size": 3, "sha256": "e" * 64}}],
    }
    assert af.compare_inventories([], [])["summary"] == {"added": 0, "removed": 0, "modified": 0, "unchanged": 0}


@pytest.mark.parametrize("bad", [{}, [1], [entry("a") | {"x": 1}], [entry("")], [entry("/a")], [entry("a/../b")], [entry("a"), entry("a")], [entry("a", size=-1)], [entry("a", size=1.0)], [entry("a", size=True)], [entry("a", "A" * 64)], [entry("a", "a" * 63)]])
def test_invalid_inventories(bad):
    with pytest.raises(af.InvalidInventoryError):
        af.compare_inventories(bad, [])


def test_verification(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for name in ("keep", "change", "gone"):
        (root / name).write_text(name)
    listed = root / "manifest.json"
    assert main(["file-inventory", str(root), "--output", str(tmp_path / "m")]) == 0
    listed.write_text((tmp_path / "m").read_text())
    assert main(["manifest-verify", str(root), str(listed)]) == 0
    (root / "change").write_text("other")
    (root / "gone").unlink()
    (root / "new").write_text("n")
    assert af.verify_directory(root, listed)["summary"] == {"added": 1, "removed": 1, "modified": 1, "unchanged": 1}
    assert main(["manifest-verify", str(root), str(listed)]) == 1
    assert main(["manifest-verify", str(tmp_path / "none"), str(listed)]) == 2


def test_duplicates(spark, tmp_path):
    report = af.find_duplicates([entry("c", A, 10), entry("a", A, 10), entry("b", A, 10), entry("d", B, 3), entry("e", A, 3)])
    assert report["summary"] == {"scanned_files": 5, "eligible_files": 5, "duplicate_groups": 1, "duplicate_files": 3, "reclaimable_bytes": 20}
    assert report["groups"] == [{"sha256": A, "size": 10, "count": 3, "reclaimable_bytes": 20, "paths": ["a", "b", "c"]}]
    assert af.find_duplicates([entry("a", A, 0), entry("b", A, 0)])["groups"] == []
    assert [g["size"] for g in af.find_duplicates([entry("a", A, 4), entry("b", A, 4), entry("c", B, 8), entry("d", B, 8)])["groups"]] == [8, 4]
    file = tmp_path / "i.json"
    file.write_text(json.dumps([entry("a"), entry("b")]))
    assert main(["manifest-duplicates", str(file)]) == 0
    assert main(["manifest-duplicates", str(file), "--fail-on-duplicates"]) == 1
    assert main(["manifest-duplicates", str(file), "--min-size", "-1"]) == 2


def test_policy(spark):
    policy = {"version": 1, "max_files": 2, "max_total_bytes": 100, "max_file_bytes": 50, "required_paths": ["LICENSE"], "forbidden_patterns": ["secrets", "*.bin"]}
    report = af.audit_inventory_policy([entry("a", size=5), entry("secrets/x.bin", B, 200), entry("secrets/y", C, 10)], policy)
    assert [v["rule"] for v in report["violations"]] == ["max_files", "max_total_bytes", "max_file_bytes", "required_path", "forbidden_pattern", "forbidden_pattern"]
    assert report["violations"][0] == {"rule": "max_files", "actual": 3, "maximum": 2, "excess": 1}
    assert report["violations"][2]["offending_files"] == [{"path": "secrets/x.bin", "size": 200}]
    assert report["violations"][4]["patterns"] == ["*.bin", "secrets"]
    assert af.audit_inventory_policy([], {"version": 1})["passed"]
    for bad in ([], {"version": True}, {"version": 1, "x": 1}, {"version": 1, "max_files": -1}, {"version": 1, "required_paths": ["*"]}, {"version": 1, "required_paths": ["a", "a"]}, {"version": 1, "forbidden_patterns": ["/x"]}, {"version": 1, "forbidden_patterns": [1]}):
        with pytest.raises(af.InvalidPolicyError):
            af.audit_inventory_policy([], bad)


CSV_RULES = {"required_columns": ["id"], "not_empty_columns": ["id", "event"], "unique_column": "id", "column_types": {"id": "integer", "amount": "number"}}


def test_csv(spark):
    report = af.audit_csv(["id,event,amount\n", "1,a,2.5\n", "\n", "2,b\n", '1,,NaN\n'], **CSV_RULES)
    assert codes(report) == ["blank_row", "row_width", "empty_required_values", "duplicate_unique_value", "invalid_type"]
    assert report["issues"][3] == {"code": "duplicate_unique_value", "line": 5, "column": "id", "first_line": 2}
    s = report["summary"]
    assert (s["data_rows"], s["valid_rows"], s["invalid_rows"], s["blank_rows"], s["duplicate_rows"], s["physical_lines_read"]) == (4, 1, 3, 1, 1, 5)
    assert list(report["summary"]["issue_codes"]) == sorted(report["summary"]["issue_codes"])
    clean = af.audit_csv(["id,date,amount,active\n", '1,2024-02-29,-1e3,true\n', "2,,,\n"], column_types={"id": "integer", "date": "date", "amount": "number", "active": "boolean"})
    assert clean["passed"] and clean["summary"]["valid_rows"] == 2


def test_csv_faults(spark):
    head = af.audit_csv(["id,id,,value\n"], required_columns=["x"], not_empty_columns=["y"])
    assert codes(head) == ["empty_header_columns", "duplicate_header_columns", "missing_required_columns", "missing_rule_columns"]
    assert head["issues"][0]["columns"] == [3] and head["issues"][1]["columns"] == ["id"] and not head["summary"]["header_valid"]
    assert codes(af.audit_csv([])) == codes(af.audit_csv(["\n", "a\n"])) == ["missing_header"]
    big = af.audit_csv(["a\n", "ééé\n"], max_field_bytes=5)
    assert big["issues"] == [{"code": "field_too_large", "line": 2, "column": "a", "actual_bytes": 6, "maximum_bytes": 5}]
    few = af.audit_csv(["a,b\n", "1\n", "2\n", "3\n"], max_errors=2)
    assert (few["summary"]["issue_count"], few["summary"]["reported_issues"], few["summary"]["truncated_issues"]) == (3, 2, 1)
    ended = af.audit_csv(["a,b\n", '1,"x\n'])
    assert ended["summary"]["stopped_early"] and codes(ended) == ["csv_parse_error"]
    types = af.audit_csv(["n\n", *[f'"{x}"\n' for x in ("1_000", "١٢", "\xa07 ", "0x1", "1d", "inf", "1e999", "_1")]], column_types={"n": "number"})
    assert [x["line"] for x in types["issues"]] == [5, 6, 7, 8, 9]
    for bad in ({"max_errors": 0}, {"max_errors": None}, {"column_types": {"a": "x"}}, {"required_columns": "a"}, {"not_empty_columns": ["a", "a"]}, {"unique_column": ""}, {"max_field_bytes": True}):
        with pytest.raises(ValueError):
            af.audit_csv([], **bad)


def test_jsonl(spark, tmp_path):
    lines = ['{"id":1,"event":"a"}', "", "[1]", '{"a":{"b":1,"b":2}}', '{"id":2}', '{"event":"x","id":1}', '{"id":NaN}', '{"id":']
    report = af.audit_jsonl(lines, required_fields=["id", "event"], unique_field="id")
    assert codes(report, "errors") == ["blank_line", "non_object_record", "duplicate_json_key", "missing_required_fields", "duplicate_unique_value", "invalid_json_constant", "invalid_json"]
    assert report["errors"][4] == {"line": 6, "code": "duplicate_unique_value", "field": "id", "first_line": 1}
    assert report["summary"]["invalid_lines"] == 7 and report["summary"]["valid_records"] == 1
    big = af.audit_jsonl(['{"value":"é"}'], max_line_bytes=13)
    assert big["errors"] == [{"line": 1, "code": "line_too_large", "actual_bytes": 14, "maximum_bytes": 13}] and big["summary"]["object_records"] == 1
    assert af.audit_jsonl(["  "], allow_blank_lines=True)["passed"] and af.audit_jsonl([])["passed"]
    assert codes(af.audit_jsonl(["{}"], unique_field="id"), "errors") == ["missing_unique_field"]
    keys = af.audit_jsonl(['{"k":1}', '{"k":1.0}', '{"k":"1"}', '{"k":true}', '{"k":null}', '{"k":{"b":1,"a":2}}', '{"k":{"a":2,"b":1}}'], unique_field="k")
    assert [(e["line"], e["first_line"]) for e in keys["errors"]] == [(7, 6)]
    file = tmp_path / "x.jsonl"
    file.write_bytes(b'\xef\xbb\xbf{"id":1}\r\n\n{"id":1}')
    assert [e["line"] for e in af.audit_jsonl(file, unique_field="id")["errors"]] == [2, 3]
    assert main(["jsonl-audit", str(file), "--unique-field", "id"]) == 1
    file.write_bytes(b"\xff")
    assert main(["jsonl-audit", str(file)]) == 2
    with pytest.raises(ValueError):
        af.audit_jsonl(['{"id":1e999}'], unique_field="id")


def text(tmp_path, data, **rules):
    (tmp_path / "t").write_bytes(data)
    return af.audit_text_file(tmp_path / "t", **rules)


def test_text(spark, tmp_path):
    mixed = text(tmp_path, b"alpha \r\nbeta\nlast", max_line_bytes=5)
    assert codes(mixed) == ["mixed_newlines", "missing_final_newline", "trailing_whitespace", "line_too_large"]
    s = mixed["summary"]
    assert (s["newline_style"], s["crlf_endings"], s["lf_endings"], s["bare_cr_endings"], s["line_count"], s["trailing_whitespace_lines"], s["maximum_line_bytes"]) == ("mixed", 1, 1, 0, 3, 1, 6)
    raw = text(tmp_path, b"\xef\xbb\xbfalpha\x00\xff\r")
    assert codes(raw) == ["utf8_bom", "nul_bytes", "invalid_utf8", "bare_cr_newline"] and raw["issues"][2]["byte_offset"] == 9
    assert raw["summary"]["has_final_newline"] and raw["summary"]["newline_style"] == "cr"
    few = text(tmp_path, b"one \ntwo \nthree ", max_errors=2)["summary"]
    assert (few["issue_count"], few["reported_issues"], few["truncated_issues"]) == (4, 2, 2)
    assert text(tmp_path, b"")["passed"] and text(tmp_path, b"x", require_final_newline=False)["passed"]
    with pytest.raises(ValueError):
        text(tmp_path, b"12345", max_file_bytes=4)
    assert main(["text-audit", str(tmp_path / "t"), "--output", str(tmp_path / "t")]) == 2


def test_zip(spark, tmp_path):
    file = tmp_path / "z.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z, pytest.warns(UserWarning):
        for name in ("../up", "/abs", "C:x", "a\\b", "a//b", "ok.txt", "OK.txt", "ok.txt", "Straße", "STRASSE"):
            z.writestr(zipfile.ZipInfo(name), "x")
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "t")
        z.writestr("big", "0" * 5000)
    report = af.audit_zip(file, max_entry_uncompressed_bytes=4000, max_total_uncompressed_bytes=4500, max_compression_ratio=5)
    got = [(x["code"], x.get("entry_index")) for x in report["issues"]]
    assert got == [
        ("parent_traversal", 1), ("absolute_or_drive_path", 2), ("non_normalized_path", 2), ("absolute_or_drive_path", 3), ("backslash_path", 4), ("non_normalized_path", 5), ("case_collision", 7), ("duplicate_path", 8),
        ("case_collision", 10), ("symlink_entry", 11), ("entry_too_large", 12), ("compression_ratio_exceeded", 12), ("archive_too_large", None),
    ]
    assert report["issues"][7]["first_entry_index"] == 6 and report["summary"]["entry_count"] == 12
    few = af.audit_zip(file, max_errors=2)["summary"]
    assert few["reported_issues"] == 2 and few["truncated_issues"] == few["issue_count"] - 2
    with zipfile.ZipFile(tmp_path / "e.zip", "w"):
        pass
    assert af.audit_zip(tmp_path / "e.zip")["passed"]
    (tmp_path / "bad").write_text("no archive")
    assert main(["zip-audit", str(tmp_path / "bad")]) == 2


def test_sqlite(spark, tmp_path):
    file = tmp_path / "d.sqlite"
    db = sqlite3.connect(file)
    db.executescript(
        "CREATE TABLE parent(id INTEGER PRIMARY KEY, name TEXT NOT NULL); CREATE TABLE child(id INTEGER PRIMARY KEY, parent_id INTEGER NOT NULL REFERENCES parent(id));"
        "CREATE INDEX child_parent ON child(parent_id); INSERT INTO child VALUES (1, 7), (2, 8), (3, 9);"
    )
    db.close()
    before = file.read_bytes()
    report = af.audit_sqlite(file, max_errors=2)
    assert report["summary"]["issue_codes"] == {"foreign_key_violation": 3} and report["summary"]["reported_issues"] == 2
    assert [x["row_id"] for x in report["issues"]] == [1, 2] and report["summary"]["object_type_counts"] == {"index": 1, "table": 2}
    assert report["tables"][0] == {"name": "child", "column_count": 2, "hidden_column_count": 0, "not_null_column_count": 1, "primary_key_column_count": 1, "foreign_key_count": 1, "index_count": 1}
    assert file.read_bytes() == before
    (tmp_path / "n").write_text("not a database, but long enough to be read as one" * 40)
    assert main(["sqlite-audit", str(tmp_path / "n")]) == 2
    assert main(["sqlite-audit", str(file), "--output", str(file)]) == 2

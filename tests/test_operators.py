"""Operators over many files and odd tables, and the driver's entry points."""

import fnmatch
import os
import random
import subprocess
import sys
from pathlib import Path, PurePosixPath

import pytest
from pyspark.sql import functions as F

from auditframe.config import is_normal_path
from auditframe.functions import columns
from auditframe.operators import catalogrules, csvrules, issues, jsonlrules, manifest, textrules, ziprules
from auditframe.sources import readers
from auditframe.sources.lines import numbered_lines
from auditframe.streaming import rules as streaming

ROOT = Path(__file__).parent.parent


def test_globs_and_paths_agree_with_python(spark):
    make = random.Random(1)
    paths = list({"/".join("".join(make.choice("ab.*[]!-é^&\\") for _ in range(make.randrange(1, 4))) for _ in range(make.randrange(1, 4))) for _ in range(200)} | {"a", "a/", "/a", "a//b", ".", "..", "a/./b", "a/.."})
    patterns = list({"".join(make.choice("ab*?[]!-é/&^") for _ in range(make.randrange(1, 6))) for _ in range(60)})
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", columns.normal_path(F.col("path")).alias("normal"), *[columns.matches_glob(F.col("path"), p).alias(f"m{i}") for i, p in enumerate(patterns)]).collect()
    for row in got:
        pure = PurePosixPath(row["path"])
        normal = not pure.is_absolute() and row["path"] == pure.as_posix() and ".." not in pure.parts and "\\" not in row["path"] and row["path"] != "."
        assert row["normal"] == normal == is_normal_path(row["path"]), row["path"]
        parts = row["path"].split("/")
        for i, p in enumerate(patterns):
            assert row[f"m{i}"] == any(fnmatch.fnmatchcase("/".join(parts[:n]), p) for n in range(1, len(parts) + 1)), (row["path"], p)


@pytest.mark.parametrize("size", ["64", "1048576"])
def test_line_numbers_whatever_the_splits(spark, tmp_path, size):
    expected = []
    for name, end in (("a.txt", b"\n"), ("b.txt", b"\r\n"), ("c.txt", b"\n")):
        lines = [b"x" * (i % 7) for i in range(300)]
        (tmp_path / name).write_bytes(end.join(lines) + (end if name != "c.txt" else b"!"))
        expected += [(name, i, line.decode() + ("!" if name == "c.txt" and i == 300 else "")) for i, line in enumerate(lines, 1)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = [(r["file"].rsplit("/", 1)[1], r["line"], r["content"]) for r in numbered_lines(spark, sorted(tmp_path.iterdir())).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(expected)


def test_many_csv_files(spark, tmp_path):
    for name, text in (("a", "id,n\n1,x\n1,2\n"), ("b", "n,id\n5,1\n5\n"), ("c", ""), ("d", '﻿id,n\n1,"x')):
        (tmp_path / name).write_text(text)
    rows = readers.csv_files(spark, sorted(tmp_path.iterdir()))
    rules = csvrules.CsvRules(unique="id", types={"n": "integer"})
    got = [(r["file"][-1], r["code"], r["line"]) for r in csvrules.csv_issues(rows, rules).orderBy("file", *issues.ORDER).collect()]
    assert got == [("a", "invalid_type", 2), ("a", "duplicate_unique_value", 3), ("b", "row_width", 3), ("c", "missing_header", None), ("d", "csv_parse_error", 2)]
    counts = {r["file"][-1]: (r["data_rows"], r["valid_rows"], r["duplicate_rows"]) for r in csvrules.csv_summary(rows, rules).collect()}
    assert counts == {"a": (2, 0, 1), "b": (2, 1, 0)}
    first = issues.reported(csvrules.csv_issues(rows, rules), 1, "file").collect()
    assert len(first) == 4 and {r["issue_no"] for r in first} == {1}


def test_records_with_broken_quoting(spark, tmp_path):
    from auditframe.plans import audits

    lines = ["id,occurred_on,event,duration_ms,success", "1,2031-01-01,x,1,true", '2,"2031-01-01,x,1,true', "1,2031-01-01,x,1,true", '"a"b,,x,,']
    table = [("a", i, raw) for i, raw in enumerate(lines, 1)] + [("b", 1, lines[0]), ("b", 2, '"open')]
    spark.createDataFrame(table, "file_name string, line_no int, raw_line string").write.parquet(str(tmp_path / "csv_lines.parquet"))
    assert sorted((r["file"], r["line"], r["code"]) for r in audits.csv_issues(spark, str(tmp_path)).collect()) == [("a", 3, "csv_parse_error"), ("a", 4, "duplicate_unique_value"), ("a", 5, "csv_parse_error"), ("b", 2, "csv_parse_error")]
    assert sorted(map(tuple, audits.csv_summary(spark, str(tmp_path)).collect())) == [("a", 4, 1, 3, 0, 1, 10), ("b", 1, 0, 1, 0, 0, 0)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "path string, size bigint, sha256 string, change string, idx bigint")
    assert manifest.difference_summary(empty, empty).first().asDict() == {"added": 0, "removed": 0, "modified": 0, "unchanged": 0}
    assert manifest.duplicate_summary(empty).first()["scanned_files"] == 0 and manifest.duplicate_files(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, "", 1), ("a", 1, "a" * 64, "", 2), ("a", 1, "a" * 64, "", 3), ("b" * 100_000, None, None, "", 4), ("c", -1, "a" * 64, "", 5), ("d", 1, "A" * 64, "", 6), ("a/../b", 1, "a" * 64, "", 7), ("", 1, "a" * 64, "", 8)], empty.schema)
    assert {r["idx"]: r["fault"] for r in manifest.faults(odd).collect()} == {1: "invalid_path", 3: "duplicate_path", 4: "invalid_size", 5: "invalid_size", 6: "invalid_digest", 7: "not_normalized", 8: "invalid_path"}
    assert manifest.duplicate_files(odd).count() == 4  # with the two odd paths of the same content
    assert manifest.verified(empty, odd.filter("idx in (2, 5)"), "a").select("path").collect() == [("c",)]
    assert manifest.verified(odd.filter("idx = 2"), odd.filter("idx in (2, 5)"), "a").count() == 2
    texts = spark.createDataFrame([("n", None, 1), ("e", b"", 1), ("l", b"x " * 300_000, 1)], "file string, content binary, count int")
    assert sorted((r["file"], r["code"]) for r in textrules.text_issues(texts, textrules.TextRules()).collect()) == [("l", "missing_final_newline"), ("l", "trailing_whitespace")]
    assert {r["file"]: r["line_count"] for r in textrules.text_summary(texts).collect()} == {"n": 0, "e": 0, "l": 1}
    lines = spark.createDataFrame([("f", 1, None, 1), ("f", 2, "", 1), ("f", 3, " ", 1), ("g", 1, '{"k":' + "[" * 100_000, 1)], "file string, line bigint, content string, key int")
    assert sorted((r["file"], r["code"]) for r in jsonlrules.jsonl_issues(lines, jsonlrules.JsonlRules()).collect()) == [("f", "blank_line")] * 3 + [("g", "unreadable")]
    entries = spark.createDataFrame([("z", 1, None, False, None, None, None, None, 1)], ziprules.ENTRY_SCHEMA + ", canonical int")
    assert sorted(r["code"] for r in ziprules.zip_issues(entries, ziprules.ZipRules()).collect()) == ["invalid_path", "non_normalized_path"]


def test_orphans(spark):
    child = spark.createDataFrame([(1, 1, "x"), (2, 9, "x"), (3, None, "x")], "id int, a int, p0 string")
    parent = spark.createDataFrame([(1,), (2,)], "a int")
    assert [r["id"] for r in catalogrules.orphans(child, parent, ["a"], ["a"]).collect()] == [2]


def test_streams(spark, tmp_path):
    rows = [(1, 2, "1,2031-01-01,x,1,true"), (2, 3, "bad"), (3, 4, '"open')]
    spark.createDataFrame(rows, "line_id bigint, line_no int, raw_line string").repartition(3).write.parquet(str(tmp_path / "s"))
    stream = streaming.rejected_stream(streaming.stream_of(spark, str(tmp_path / "s"), 1))
    assert sorted(map(tuple, streaming.drained(stream, "test").collect())) == [(2, "width"), (3, "quoting")]
    events = spark.createDataFrame([(1, "2031-01-01 00:00:00"), (1, "2031-01-01 00:00:05"), (2, "2031-01-01 00:00:09")], "id int, at string").select("id", F.col("at").cast("timestamp").alias("at"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    seen = streaming.first_seen(streaming.stream_of(spark, str(tmp_path / "e")), ["id"], "at", "1 minute")
    assert streaming.drained(seen, "test").count() == 2


def test_entry_points():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p1_found", "p3_found", "p4_found", "p5_found"} <= set(names)


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['auditframe.llm'] = None; sys.modules['auditframe.llm.queries'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith(('p2_', 'p6_', 'p7_', 'p8_'))]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=True)


def test_installed_commands(monkeypatch, capsys, tmp_path):
    import tomllib
    from importlib.metadata import EntryPoint

    from auditframe import cli

    scripts = tomllib.loads((ROOT / "pyproject.toml").read_text())["project"]["scripts"]
    assert set(scripts) == set(cli.COMMANDS)
    (tmp_path / "a.json").write_text("[]")
    monkeypatch.setattr(sys, "argv", ["manifest-duplicates", str(tmp_path / "missing.json")])
    with pytest.raises(SystemExit) as ended:
        EntryPoint("manifest-duplicates", scripts["manifest-duplicates"], "console_scripts").load()()
    assert ended.value.code == 2 and "error" in capsys.readouterr().err


def test_numbers_as_python_reads_them(spark):
    values = ["1", " 1_0.5e3 ", "1__0", "\u0661\u0662", "\u00a01\u00a0", "\uff11.\uff15", "1\u0661", "nan", "inf", "1e999", "", ".", "\x1c1", "\x1c\u0661", "\U0001d7d0", "\u00b2", "x\u0661", "-\u0967_\u0968"]

    def fits(value):
        try:
            return abs(float(value)) < float("inf")
        except ValueError:
            return False

    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", columns.is_type(F.col("v"), "number").alias("n"))
    assert {r["v"]: r["n"] for r in got.collect()} == {v: fits(v) for v in values}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()

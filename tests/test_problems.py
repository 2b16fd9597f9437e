"""Reject parsing, snapshot changes, copies and load profiles on small and odd tables."""

import csv
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditframe.operators import copies, profile, rejects, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- records that don't parse ----------------------------------------------------------------

GOOD = "7,2031-01-02,started,1.5,true"
CASES = {
    GOOD: [], GOOD + "\r\n": [], GOOD + "\r": [], ",,,,": [], '1,"","a, ""b""\nc",,': [], "1,2031-01-02,a 8\" b, +1.5e3 ,false": [], "": ["width"], None: ["width"], "a,b": ["width"], "1,2,3,4,5,6": ["width"],
    '1,"2031-01-02,x,1,true': ["quoting"], '1,"2031-01-02" ,x,1,true': ["quoting"], '"a"b': ["quoting"], '1,"a\nb': ["quoting"], "1,2031-02-30,x,1,true": ["occurred_on"], "1,2031-1-02,x,1,true": ["occurred_on"], "1,0000-01-01,x,1,true": ["occurred_on"],
    "1, 2031-01-02,x,1,true": ["occurred_on"], "1,,x,NaN,true": ["duration_ms"], "1,,x,1e999,true": ["duration_ms"], "1,,x,1_0,true": ["duration_ms"], "1,,x,12ms,TRUE": ["duration_ms", "success"], "1,x,x,x,x": ["occurred_on", "duration_ms", "success"],
    "1,2031-01-02,a\nb,1,true": [], "1,,x,.5,": [], "1,,x,5.,": [], "1,,x,.,": ["duration_ms"], "1,,x, ,": ["duration_ms"], '1,,"x\r\ny",1,true\r\n': [], '1,,x,"1","true"': [], "x" * 200_000: ["width"],
}


def test_reasons(spark):
    table = spark.createDataFrame(list(enumerate(CASES)), "line_id bigint, raw_line string").withColumns({"reasons": F.lit(1), "record": F.lit(2)})
    parsed = {r["line_id"]: r for r in rejects.parse_events(table).collect()}
    for i, (raw, reasons) in enumerate(CASES.items()):
        assert parsed[i]["reasons"] == reasons, raw
        assert (parsed[i]["record"] is None) == bool(reasons)
    assert parsed[0]["record"].duration_ms == 1.5 and parsed[0]["record"].success is True and str(parsed[0]["record"].occurred_on) == "2031-01-02"
    assert rejects.rejected(rejects.parse_events(table)).count() == sum(map(len, CASES.values()))
    assert rejects.accepted(rejects.parse_events(table.limit(0))).count() == 0


def test_scanner_agrees_with_the_reader():
    make = random.Random(5)
    for _ in range(20_000):
        record = "".join(make.choice('a",b ') for _ in range(make.randrange(12)))
        try:
            expected = list(csv.reader([record], strict=True))[0] if record else [""]
        except csv.Error:
            expected = None
        assert rejects.scan_fields(record) == expected, record


# ---- snapshots -------------------------------------------------------------------------------

SNAPSHOT = "root_name string, snapshot_no int, recorded_at timestamp, path string, size bigint, sha256 string, snaps string"


def brute_changes(table):
    held = {}
    for root, no, at, path, size, digest, _ in table:
        if None in (root, no, path):
            continue
        snap = held.setdefault(root, {}).setdefault(no, {})
        if path not in snap or (at is not None and (snap[path][0] is None or at >= snap[path][0])):
            snap[path] = (at, size, digest)
    out = []
    for root, by_no in held.items():
        for old, new in zip(sorted(by_no), sorted(by_no)[1:]):
            a, b = by_no[old], by_no[new]
            out += [(root, new, p, "added") for p in b.keys() - a.keys()] + [(root, new, p, "removed") for p in a.keys() - b.keys()]
            out += [(root, new, p, "changed") for p in a.keys() & b.keys() if a[p][1:] != b[p][1:]]
    return sorted(out, key=repr)


def random_snapshots(seed, n=400):
    make, start = random.Random(seed), datetime(2031, 1, 1)
    return [
        (make.choice(["r1", "r1", "r2", "é"]), make.choice([1, 2, 4, 5, 9]), start + timedelta(seconds=i), make.choice(["a", "b", ".c", "d/é", "é", "f"]) + make.choice(["", "1", "2"]), make.choice([None, 1, 2]), make.choice([None, "x", "y"]), "z")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_changes(spark, seed):
    table = random_snapshots(seed, 60 + 100 * seed)
    df = spark.createDataFrame(table, SNAPSHOT)
    expected = brute_changes(table)
    assert rows(snapshots.snapshot_changes(df)) == expected
    assert rows(snapshots.replay(df)) == expected


def test_snapshots_one_by_one(spark):
    table = random_snapshots(9)
    found, index = [], None
    for no in (1, 2, 4, 5, 9):
        batch = spark.createDataFrame([r for r in table if r[1] == no], SNAPSHOT)
        found += rows(snapshots.snapshot_changes(batch, index))
        new = snapshots.next_index(batch, index)
        if index is not None:
            index.drop(spark)
        index = new
    assert sorted(found, key=repr) == brute_changes(table)


def test_an_index_outlives_its_session(spark, tmp_path):
    table = random_snapshots(6)
    df = spark.createDataFrame(table, SNAPSHOT)
    old = df.filter("snapshot_no <= 4")
    index = snapshots.next_index(old, location=str(tmp_path / "index"))
    spark.sql(f"drop table {index.table}")  # as another session's catalog doesn't have it
    index = snapshots.SnapshotIndex.open(spark, str(tmp_path / "index"))
    new = df.filter("snapshot_no > 4")
    found = rows(snapshots.snapshot_changes(old)) + rows(snapshots.snapshot_changes(new, index))
    assert sorted(found, key=repr) == brute_changes(table)
    after = snapshots.next_index(new, index)
    index.drop(spark)
    assert rows(snapshots.SnapshotIndex.open(spark, str(tmp_path / "index")).rows(spark)) == rows(after.rows(spark)) == rows(snapshots.next_index(df).rows(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = after.rows(spark)
        plan = held.join(held.groupBy("root_name", "path").agg(F.max("snapshot_no").alias("n")), ["root_name", "path"], "full_outer")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_replay_swaps_the_index_for_each_delivery(spark, monkeypatch):
    table, swaps, own = random_snapshots(4), [], snapshots.next_index
    monkeypatch.setattr(snapshots, "next_index", lambda batch, index=None, **more: swaps.append(index) or own(batch, index, **more))
    df = spark.createDataFrame(table, SNAPSHOT)
    assert rows(snapshots.replay(df)) == brute_changes(table)
    assert len(swaps) == 5 and swaps[0] is None and len({index.table for index in swaps[1:]}) == 4
    held = {(root, no, path): (size, digest) for root, no, _, path, size, digest, _ in table}
    before = {(root, no): old for root in {r for r, *_ in table} for old, no in zip((1, 2, 4, 5), (2, 4, 5, 9))}
    expected = [(r, no, p, *held[r, before[r, no], p], *held[r, no, p]) for r, no, p, kind in brute_changes(table) if kind == "changed"]
    assert rows(snapshots.replay_values(df)) == sorted(expected, key=repr)


def test_snapshots_odd_tables(spark):
    at = datetime(2031, 1, 1)
    assert rows(snapshots.replay(spark.createDataFrame([], SNAPSHOT))) == []
    table = [(None, 1, at, "a", 1, "x", ""), ("r", None, at, "a", 1, "x", ""), ("r", 1, at, None, 1, "x", ""), ("r", 1, None, "a", 1, "x", ""), ("r", 2, None, "a", None, None, ""), ("r", 3, at, "a", None, None, ""), ("r", 3, at, "p" * 100_000, 1, "x", "")]
    assert rows(snapshots.replay(spark.createDataFrame(table, SNAPSHOT))) == [("r", 2, "a", "changed"), ("r", 3, "p" * 100_000, "added")]
    before, after = spark.createDataFrame(table[3:4], SNAPSHOT), spark.createDataFrame(table[4:5], SNAPSHOT)
    changes = snapshots.snapshot_changes(before.union(after))
    assert snapshots.changed_values(changes, before, after).select("old_value.size", "new_value.size").first() == (1, None)


# ---- two copies ------------------------------------------------------------------------------

COPY = "vol_name string, path string, size bigint, sha256 string, seen_at timestamp, k0 string, finding string"


def test_copies(spark):
    early, late = datetime(2031, 1, 1), datetime(2031, 1, 2)
    left = [("v", "same", 1, "AA", early, "", ""), ("v", "old", 1, "a", early, "", ""), ("v", "old", 2, "b", late, "", ""), ("v", "both", 1, "a", early, "", ""), ("v", "null", None, None, early, "", ""), ("v", "half", None, "a", None, "", ""), ("v", "left", 1, "a", early, "", ""), ("v", "left", 1, "a", early, "", ""), (None, None, 1, "a", early, "", "")]
    right = [("v", "same", 1, "aa", late, "", ""), ("v", "old", 2, "b", early, "", ""), ("v", "both", 2, "b", early, "", ""), ("v", "null", None, None, early, "", ""), ("v", "half", 1, "a", None, "", ""), ("v", "right", 1, "a", early, "", ""), (None, None, 2, "a", early, "", "")]
    frames = [spark.createDataFrame(x, COPY) for x in (left, right)]
    compare = lambda a, b: rows(copies.compare_copies(a, b, ["vol_name", "path"], {"size": "size", "sha256": "lower(sha256)"}, "seen_at", ("primary", "replica")))
    assert compare(*frames) == sorted(
        [("v", "both", "size"), ("v", "both", "sha256"), ("v", "half", "size"), ("v", "left", "missing_in_replica"), ("v", "right", "missing_in_primary"), (None, None, "size")], key=repr
    )
    empty = frames[0].limit(0)
    assert compare(empty, empty) == []
    assert {f for _, _, f in compare(frames[0], empty)} == {"missing_in_replica"}


# ---- profiles --------------------------------------------------------------------------------

LOG = "feed string, load_no int, occurred_on string, duration_ms string, status string, median string, value string"


def load(feed, no, days, durations, statuses):
    return [(feed, no, d, m, s, "", "") for d, m, s in zip(days, durations, statuses)]


def test_shifted_loads(spark):
    base = (["2031-01-01"] * 10, ["10"] * 10, ["ok"] * 10)
    table = load("same", 1, *base) + load("same", 3, *base)
    table += load("null", 1, *base) + load("null", 2, [None] * 2 + ["2031-01-01"] * 8, ["10"] * 9 + [None], ["ok"] * 8 + [None] * 2)
    table += load("form", 1, *base) + load("form", 2, ["2031-13-01"] * 2 + ["2031-01-01"] * 8, ["x"] + ["10"] * 9, base[2])
    table += load("back", 1, *base) + load("back", 2, ["2030-12-31"] * 5 + ["2031-01-01"] * 5, ["10"] * 5 + ["15"] * 5, base[2]) + load("back", 3, ["2031-02-01"] * 10, ["15.1"] * 10, base[2])
    table += load("mix", 1, *base) + load("mix", 2, ["2031-01-31"] * 10, ["6"] * 10, ["ok"] * 8 + ["a", "b"]) + load("mix", 5, ["", *["2031-01-31"] * 9], ["6"] * 10, ["a"] * 4 + ["ok"] * 6)
    table += load("void", 1, *base) + load("void", 2, [None], [None], [None]) + load("void", 3, *base)
    found = rows(profile.shifted_loads(spark.createDataFrame(table, LOG)))
    every = ["duration_ms", "occurred_on", "status"]
    assert found == sorted(
        [("null", 2, "occurred_on"), ("null", 2, "status"), ("form", 2, "occurred_on"), ("back", 2, "occurred_on"), ("back", 3, "occurred_on"), ("back", 3, "duration_ms"), ("mix", 2, "duration_ms"), ("mix", 2, "status"), ("mix", 5, "status")]
        + [("void", n, f) for n in (2, 3) for f in every], key=repr,
    )
    assert rows(profile.shifted_loads(spark.createDataFrame([], LOG))) == []


def test_medians_are_exact(spark):
    make = random.Random(3)
    values = {f"f{k}": [make.choice([-1, 1]) * make.choice([0, 1e-9, 0.37, 5, 1234.5, 1e300]) * make.random() for _ in range(make.randrange(1, 400))] for k in range(12)}
    table = [(f, 1, None, repr(v), None, "", "") for f, vs in values.items() for v in vs]
    stats = profile.load_statistics(profile.judged_counts(profile.value_counts(spark.createDataFrame(table, LOG), ["feed", "load_no"], ["duration_ms"]), {"duration_ms": "number"}), ["feed", "load_no"])
    assert {r["feed"]: r["median"] for r in stats.collect()} == {f: sorted(vs)[(len(vs) - 1) // 2] for f, vs in values.items()}


def test_profile_with_masks(spark):
    table = load("f", 1, ["2031-01-01"] * 199 + ["01/02/2031"], ["1.5"] * 200, ["ok"] * 100 + ["Bad"] * 100) + load("f", 2, ["2031-01-01"] * 100 + ["01/02/2031"] * 100, ["1.5"] * 200, [None] * 200)
    got = {(r["load_no"], r["field_name"]): r for r in profile.profile_loads(spark.createDataFrame(table, LOG), ["feed", "load_no"], "load_no", ["occurred_on", "status"], {"occurred_on": "date"}).collect()}
    first, second = got[1, "occurred_on"], got[2, "occurred_on"]
    assert first["dominant_masks"] == ["9+-9+-9+"] and first["off_form"] == 1 and abs(first["rare_share"] - 0.005) < 1e-9 and first["mask_shift"] is None
    assert second["dominant_masks"] == ["9+-9+-9+", "9+/9+/9+"] and abs(second["mask_shift"] - 0.495) < 1e-9
    assert got[1, "status"]["dominant_masks"] == ["Aa+", "a+"] and got[2, "status"]["nulls"] == 200 and got[2, "status"]["dominant_masks"] is None


def test_rare_masks(spark):
    table = load("f", 1, ["2031-01-01"] * 199 + ["01/02/2031"], ["1.5"] * 200, ["ok"] * 197 + ["Bad"] * 2 + [None]) + load("f", 2, ["2031-01-01"] * 19 + ["x"], ["1.5"] * 20, ["ok"] * 18 + ["Bad"] * 2) + load("f", 3, ["x"], ["1"], [None])
    assert rows(profile.rare_masks(spark.createDataFrame(table, LOG), ["feed", "load_no"], ["occurred_on", "duration_ms", "status"])) == [("f", 1, "occurred_on", "9+/9+/9+", 1, "01/02/2031"), ("f", 2, "occurred_on", "a", 1, "x")]

"""Repeats of accepted entries, against the sequential definition."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from auditframe.llm import history as H

SCHEMA = "entry_id bigint, batch_no int, size bigint, sha256 string, body string, node string, text_key string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(table):
    import re

    accepted, out = [], []
    for entry, _, size, digest, body, *_ in sorted(table, key=lambda r: r[0]):
        if size == 0:
            continue
        words = None if body is None else re.findall(r"[^\W_]+", body.lower())
        same = lambda o: (None not in (size, digest, o[1], o[2]) and (size, digest.lower()) == (o[1], o[2].lower())) or (words is not None and o[3] is not None and (words == o[3] or 100 * distance(words, o[3]) <= 15 * max(len(words), len(o[3]))))  # noqa: B023, E731
        found = [o[0] for o in accepted if same(o)]
        if found:
            out.append((min(found), entry))
        else:
            accepted.append((entry, size, digest, words))
    return sorted(out)


def made(seed, n=220, words=40):
    """Entries of which many are copies or edits of earlier ones, some at the very limit of likeness."""
    make = random.Random(seed)
    vocabulary = [make.choice("abcdefg") * make.randrange(1, 9) + str(i % 7) for i in range(words)]
    table, bodies = [], []
    for i in range(n):
        kind = make.random()
        if bodies and kind < 0.6:
            text = list(make.choice(bodies))
            for _ in range(make.choice([0, 0, 1, 15 * len(text) // 100, 15 * len(text) // 100 + 1])):
                at = make.randrange(len(text) + 1)
                change = make.random()
                if change < 0.33:
                    text.insert(at, make.choice(vocabulary))
                elif text and change < 0.66:
                    text.pop(at % len(text))
                elif text:
                    text[at % len(text)] = make.choice(vocabulary)
        else:
            text = [make.choice(vocabulary) for _ in range(make.choice([0, 1, 5, 6, 7, 8, 20, 34, 60]))]
        bodies.append(text)
        body = make.choice([" ", "\n", ", "]).join(make.choice([str.upper, str])(w) for w in text)
        digest = make.choice([None, f"{hash(tuple(text)) % 90:064X}", f"{hash(tuple(text)) % 90:064x}"])
        table.append((2 * i + 1, i // 40, make.choice([None, 0, len(text), len(text)]), digest, make.choice([None, body, body, body]), "x", "y"))
    return table


@pytest.mark.parametrize("seed, hot, boilerplate", [(0, H.HOT, H.BOILERPLATE), (1, 3, 4)])
def test_replay(spark, seed, hot, boilerplate, monkeypatch):
    # hot signatures: parts of growing size, then refined pairs; boilerplate: last in the order
    monkeypatch.setattr(H, "HOT", hot)
    monkeypatch.setattr(H, "BOILERPLATE", boilerplate)
    table = made(seed)
    assert sorted(map(tuple, H.replay(spark.createDataFrame(table, SCHEMA), buckets=3).collect())) == brute(table)


def scans(plan):
    """Operators above each scan of the history's tables, up to the join."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "FileScan" in line and "accepted_" in line:
            depth, above = line.index("FileScan"), []
            for upper in reversed(lines[:i]):
                at = len(upper) - len(upper.lstrip(" :+-*()0123456789"))
                if at < depth:
                    above.append(upper[at:].split()[0])
                    depth = at
                    if "Join" in above[-1]:
                        break
            found.append(above)
    return found


ONE_BATCH = """
import sys
from pyspark.sql import SparkSession
from auditframe.llm import history as H
H.BOILERPLATE, H.HOT = 4, 3
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1] + "/other").getOrCreate()
batches = spark.read.parquet(sys.argv[1] + "/batches")
known = H.History.create(spark, sys.argv[1] + "/history", 3)
for no in (0, 1):
    repeats, known = H.ingest(batches.filter(f"batch_no = {no}"), known)
    repeats.write.parquet(sys.argv[1] + f"/repeats{no}")
"""


def test_history_outlives_its_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "BOILERPLATE", 4)
    monkeypatch.setattr(H, "HOT", 3)
    table = [(*row[:1], i // 40, *row[2:]) for i, row in enumerate(made(7, 200))]
    df = spark.createDataFrame(table, SCHEMA)
    df.write.parquet(str(tmp_path / "batches"))
    subprocess.run([sys.executable, "-c", ONE_BATCH, str(tmp_path)], check=True, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "pyspark-shell"})
    found = [tuple(r) for no in (0, 1) for r in spark.read.parquet(str(tmp_path / f"repeats{no}")).collect()]
    known = H.History.open(spark, str(tmp_path / "history"))
    # an append that never was finished is not read
    known._log(spark, 3, False)
    spark.range(3).selectExpr("id as sig", "id as text_id", "9 as n_words", "3 as ingest").repartition(3, "sig").transform(lambda rows: H.add_to_table(rows, known.table(spark, "signatures"), 3, "sig") or rows)
    old = known
    for no in (2, 3, 4):
        if no == 4:
            known = known.compacted(spark, 2)
        repeats, known = H.ingest(df.filter(f"batch_no = {no}"), known)
        found += map(tuple, repeats.collect())
    assert sorted(found) == brute(table)
    with pytest.raises(ValueError):
        H.ingest(df.filter("batch_no = 3"), old)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind, (columns, key) in H.KINDS.items():
            keys = known.rows(spark, kind).select(key).distinct()
            plan = known.probe(spark, kind, keys)._jdf.queryExecution().executedPlan().toString()
            probed = scans(plan.split("== Initial Plan ==")[-1])[0]
            assert "Join" in probed[-1] and not any("Exchange" in x or "Sort" == x for x in probed), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_common_notice(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 6)
    monkeypatch.setattr(H, "BOILERPLATE", 12)
    make, pairs = random.Random(3), []
    notice = [f"noticeofunusualwords{i}" for i in range(40)]
    monkeypatch.setattr(H, "_verified", lambda p, lower, upper, of=H._verified: pairs.append(p.count()) or of(p, lower, upper))
    table = []
    for i in range(240):
        text = [f"{make.choice('abcdefgh') * 5}{make.randrange(10_000)}" for _ in range(110)]
        if i % 40 == 39:
            text = list(table[i // 2][4].split()[40:])
            text[7] = "changed"
        table.append((i, i // 80, 1, None, " ".join([*notice, *text]), "", ""))
    expected, accepted = [], []
    for entry, _, _, _, body, *_ in table:
        words = body.split()
        found = [o for o, w in accepted if H.word_distance(words, w, H.allowed(150)) <= H.allowed(150)]
        expected += [(min(found), entry)] if found else []
        accepted += [] if found else [(entry, words)]
    found, known = [], None
    for no in range(3):
        repeats, known = H.ingest(spark.createDataFrame([r for r in table if r[1] == no], SCHEMA), known)
        found += map(tuple, repeats.collect())
    assert sorted(found) == sorted(expected) and len(found) == 6
    # texts that share the notice alone are not even compared
    assert sum(pairs) < 60


def test_odd_entries(spark):
    assert H.replay(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i}" for i in range(20_000))
    table = [(1, 1, None, None, None, "", ""), (2, 1, None, None, None, "", ""), (3, 1, 5, "A", None, "", ""), (4, 1, 5, "a", None, "", ""), (5, 1, 9, None, "", "", ""), (6, 1, 9, None, "!?", "", ""), (7, 1, 0, "a", "x", "", ""), (8, 2, 0, "a", "x", "", ""), (9, 2, 7, "b", long, "", ""), (10, 2, 7, "c", long + " more", "", ""), (None, 2, 1, "d", "q", "", "")]
    assert sorted(map(tuple, H.replay(spark.createDataFrame(table, SCHEMA)).collect())) == [(3, 4), (5, 6), (9, 10)]
    # a rejected entry doesn't stand for what repeats it alone
    chain = " ".join(f"c{i}" for i in range(20))
    other = chain.replace("c0 c1 c2 ", "d0 d1 d2 ")
    third = other.replace("c17 c18 c19", "e1 e2 e3")
    table = [(1, 1, 1, None, chain, "", ""), (2, 1, 1, None, other, "", ""), (3, 2, 1, None, third, "", "")]
    assert sorted(map(tuple, H.replay(spark.createDataFrame(table, SCHEMA)).collect())) == [(1, 2)] == brute(table)


def test_settled_by_the_final_state(spark):
    # 4 is accepted in the last round only, when 6 holds 5 already
    make = random.Random(4)
    graphs = [(7, [(0, 2), (1, 3), (3, 4), (4, 6), (5, 6)]), (40, sorted({tuple(sorted(make.sample(range(40), 2))) for _ in range(60)}))]
    for n, edges in graphs:
        accepted, expected = [], {}
        for node in range(n):
            lower = [x for x in accepted if (x, node) in edges]
            expected[node] = min(lower, default=None)
            accepted += [] if lower else [node]
        nodes = spark.createDataFrame([(i, bytes([i]), None) for i in range(n)], "node bigint, text_key binary, content_key binary")
        classes = nodes.selectExpr("text_key", "node as text_id")
        settled = H._settled(nodes, classes, spark.createDataFrame(edges, "a bigint, b bigint"))
        assert dict(map(tuple, settled.collect())) == expected


def test_distance_and_signatures():
    make = random.Random(1)
    for _ in range(3000):
        a, b = ([make.randrange(4) for _ in range(make.randrange(15))] for _ in range(2))
        d, most = distance(a, b), make.randrange(12)
        assert H.word_distance(a, b, most) == (d if d <= most else most + 1)
    for _ in range(2000):
        n = make.randrange(6, 90)
        a = [make.randrange(1, 50) << 56 | make.randrange(12) for _ in range(n)]
        b = list(a)
        for _ in range(make.randrange(1, 15)):
            at = make.randrange(len(b) + 1)
            b[at : at + make.randrange(2)] = [make.randrange(1, 50) << 56 | make.randrange(12)] * make.randrange(2)
        longer = max(len(a), len(b))
        d = distance(a, b)
        if d and 100 * d <= 15 * longer:
            shared = len(set(H.signatures(np.array(a, np.int64)).tolist()) & set(H.signatures(np.array(b, np.int64)).tolist()))
            assert shared >= min(H.SPARE + 1, longer + 2 - 3 * H.allowed(longer))

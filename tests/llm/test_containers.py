"""Containers: every token once, none over capacity, little room left."""

import random

from auditframe.llm import containers as C

DOCS = "doc_id bigint, text string, size int, capacity int"
KINDS = "container_kind string, capacity_tokens int, doc_id int"


def packed(spark, texts, kinds, **more):
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in texts], DOCS)
    return C.fill_containers(docs, spark.createDataFrame([(k, c, 0) for k, c in kinds], KINDS), **more).collect()


def test_tightest_bin():
    make = random.Random(2)
    bins, room = C.OpenBins(100), {}
    for _ in range(5000):
        size = make.choice([0, make.randrange(1, 101), make.randrange(1, 30)])
        fits = [r for r in room.values() if r >= size and r > 0]
        number = bins.put(size)
        assert room.get(number, 100) == (min(fits) if fits else 100)
        room[number] = room.get(number, 100) - size
        assert room[number] >= 0


def test_every_token_once(spark):
    make = random.Random(4)
    texts = [(i, " ".join(make.choice(["one", "zwei", "trois", "Ж", "\n"]) for _ in range(make.choice([0, 3, 40, 300, 900])))) for i in range(120)] + [(500, None), (501, ""), (900, "again"), (900, "again"), (None, "lost id")]
    kinds = [("short", 50), ("long", 400), ("none", 0), ("null", None), ("long", 400)]
    encode = C.tokenizer().encode_ordinary
    for groups in (20_000, 25):
        rows = packed(spark, texts, kinds, group_pieces=groups)
        for kind, capacity in (("short", 50), ("long", 400)):
            own = [r for r in rows if r["container_kind"] == kind]
            filled, tokens = {}, {}
            for r in own:
                filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
                tokens.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
            assert max(filled.values()) <= capacity
            for i, text in texts:
                n = len(encode(text or ""))
                pieces = sorted(tokens[i])
                assert sum(p[2] for p in pieces) == n * (2 if i == 900 else 1)
                if i != 900:
                    assert [p[1] for p in pieces] == [capacity * k for k in range(len(pieces))] and (len(pieces) == 1 or n > capacity)
            if groups == 20_000:
                assert len(filled) <= 1.05 * sum(filled.values()) / capacity + 1
        assert {r["container_kind"] for r in rows} == {"short", "long"}
    assert packed(spark, [], kinds) == [] and packed(spark, texts[:3], []) == []


def test_very_long_text(spark):
    rows = packed(spark, [(1, "word " * 200_000)], [("a", 1000)])
    assert sum(r["n_tokens"] for r in rows) == len(C.tokenizer().encode_ordinary("word " * 200_000)) and len({r["container_id"] for r in rows}) == len(rows)

"""Leaked passages, against all windows of twelve words."""

import itertools
import random

import pytest

from auditframe.llm import leaks

DOCS, ITEMS = "doc_id bigint, text string, item_id int", "item_id bigint, text string, exact_words int"


def brute(texts, items):
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words(t)] for i in range(len(w) - 11)}
    return sorted({(d, i) for d, t in texts for i, u in items if t and u and grams(t) & grams(u)})


def found(spark, texts, items):
    df = leaks.find_leaks(spark.createDataFrame([(*t, 1) for t in texts], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    return df.collect()


def test_words():
    assert leaks.words(r"The \emph{big} caf\'e_3, \alpha beta") == ["the", "big", "caf", "e", "3", "beta"]


@pytest.mark.parametrize("block", [leaks.BLOCK_CHARS, 400])
def test_against_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    make = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(make.choice(words) for _ in range(make.choice([5, 12, 30, 60])))) for i in range(25)]
    items += [(30, items[3][1]), (31, None), (32, "")]
    texts = []
    for d in range(120):
        body = [make.choice(words + ["other", "\\emph{x}", "\n%"]) for _ in range(make.choice([0, 5, 50, 200]))]
        source = leaks.words(make.choice(items[:25])[1])
        at, n = make.randrange(len(source)), make.randrange(8, 16)
        passage = [make.choice([w, w.upper(), "\\textbf{" + w + "}"]) for w in source[at : at + n]]
        k = make.randrange(len(body) + 1)
        texts.append((d, " ".join(body[:k] + passage + body[k:])))
    texts += [(200, None), (201, ""), texts[5], (None, "x")]
    got = sorted((r["doc_id"], r["item_id"]) for r in found(spark, texts, items) if r["exact_words"] >= 12)
    assert got == brute(texts, items) and got


def test_substitutions_are_bridged(spark):
    item = " ".join(f"t{i}" for i in range(40))
    text = " ".join("x" if i in (14, 25) else f"t{i}" for i in range(40))
    (row,) = found(spark, [(1, text)], [(1, item)])
    assert (row["overlap_words"], row["exact_words"]) == (40, 14)
    assert found(spark, [], [(1, item)]) == [] and found(spark, [(1, text)], []) == []
    (row,) = found(spark, [(1, "y " * 500_000 + text)], [(1, item)])
    assert row["overlap_words"] == 40
    with pytest.raises(ValueError):
        leaks.find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS), min_words=5)


def brute_overlaps(texts, items):
    """(doc, item, longest stretch with two words replaced, longest exact one), over every diagonal."""
    out = {}
    for d, t in texts:
        for i, u in items:
            a, b = leaks.words(t), leaks.words(u)
            for diagonal in range(1 - len(b), len(a)):
                same = [a[k + diagonal] == b[k] for k in range(len(b)) if 0 <= k + diagonal < len(a)]
                most = lambda n: max(y - x for x in range(len(same)) for y in range(x, len(same) + 1) if same[x:y].count(False) <= n)  # noqa: B023, E731
                if len(same) >= 12 and (near := most(2)) >= 12:
                    old = out.get((d, i), (0, 0))
                    out[d, i] = (max(old[0], near), max(old[1], most(0)))
    return sorted((*key, *lengths) for key, lengths in out.items())


def test_every_two_substitutions_are_bridged(spark):
    item = [f"t{i}" for i in range(12)]
    texts = [(k, " ".join(["y"] * 5 + ["x" if i in pair else w for i, w in enumerate(item)] + ["z"] * 5)) for k, pair in enumerate(itertools.combinations(range(12), 2))]
    got = {r["doc_id"]: r["overlap_words"] for r in found(spark, texts, [(1, " ".join(item))])}
    assert got == dict.fromkeys(range(66), 12)
    for n, replaced in ((12, 3), (8, 1), (20, 5)):
        with pytest.raises(ValueError):
            leaks.find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS), n, replaced)
    for masks in (leaks.MASKS, ("11101001", "11010011"), ("1111", "110011")):
        span = max(map(len, masks))
        windows = [[s + i for i, c in enumerate(m) if c == "1"] for m in masks for s in range(12 - span + 1)]
        for k in range(5):
            assert leaks.bridged(masks, 12, k) == all(any(not set(w) & set(p) for w in windows) for p in itertools.combinations(range(12), k))


def test_overlaps_against_all_diagonals(spark):
    make = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(make.choice(words) for _ in range(make.choice([11, 12, 13, 20, 30])))) for i in range(10)]
    texts = []
    for d in range(60):
        passage = leaks.words(make.choice(items)[1])
        for _ in range(make.choice([0, 1, 2, 2, 3])):
            passage[make.randrange(len(passage))] = make.choice([*words, "other"])
        body = [make.choice([*words, "other"]) for _ in range(make.choice([0, 5, 25]))]
        k = make.randrange(len(body) + 1)
        texts.append((d, " ".join(body[:k] + passage + body[k:])))
    got = sorted(tuple(r[c] for c in ("doc_id", "item_id", "overlap_words", "exact_words")) for r in found(spark, texts, items))
    assert got == brute_overlaps(texts, items) and {r[2] for r in got} >= {12, 13, 20, 30}

"""Passages of held-out test items inside a training corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.runtime import spread, written

#: Fixed masks, 1 where a token counts: each spans 8 tokens and ignores three of them. Whichever two of 12 tokens
#: are replaced, a window of one of them is left whole (``bridged``).
MASKS = ("11101001", "10100111")

#: Items are searched in blocks of at most this many characters, the bound of what is broadcast.
BLOCK_CHARS = 16_000_000

#: Hits of a text that are held at once, before those on one diagonal become one.
HIT_BLOCK = 1_000_000

_COMMAND = re.compile(r"\\[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; the name of a markup command is no word."""
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    return _WORD.findall(text.lower())


def bridged(masks: Sequence[str], min_words: int, substitutions: int) -> bool:
    """Whether every stretch of so many words with at most so many replaced, wherever they are, keeps a whole window of a mask."""
    span = max(map(len, masks))
    windows = [frozenset(s + i for i, c in enumerate(mask) if c == "1") for mask in masks for s in range(min_words - span + 1)]

    def kept(windows: list[frozenset[int]], left: int) -> bool:
        # a replaced word of the first window has to be one of its own, so only these are tried
        return bool(windows) and (not left or all(kept([w for w in windows if at not in w], left - 1) for at in windows[0]))

    return kept(windows, substitutions)


class SeedIndex:
    """Masked hashes of every window of the items, ready to be probed by whole batches of texts."""

    def __init__(self, items: Sequence[tuple[int, str]], masks: Sequence[str] = MASKS):
        self.offsets = [np.flatnonzero([c == "1" for c in mask]) for mask in masks]
        self.span = max(map(len, masks))
        self.ids: dict[str, int] = {}
        self.items = [(key, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.int64)) for key, text in items]
        self.tables = []
        for m in range(len(masks)):
            hashes, owners, places = [], [], []
            for k, (_, tokens) in enumerate(self.items):
                h, at = self.seeds(tokens, m)
                hashes.append(h)
                owners.append(np.full(len(h), k))
                places.append(at)
            h, k, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owners, places))
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], k[order], at[order]))

    def seeds(self, tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Masked hashes of all windows whose counted tokens are known, and where they start."""
        n = len(tokens) - self.span + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts = [tokens[o : o + n] for o in self.offsets[m]]
        known = parts[0] > 0
        for p in parts[1:]:
            known = known & (p > 0)
        at = np.flatnonzero(known)
        h = np.full(len(at), 1469598103934665603, np.uint64)
        for p in parts:
            h = (h ^ p[at].astype(np.uint64)) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        return h, at

    def hits(self, tokens: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every seed that the tokens share with an item."""
        found = set()
        for m, (table, owners, places) in enumerate(self.tables):
            h, at = self.seeds(tokens, m)
            if not len(h) or not len(table):
                continue
            first, last = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            shared = np.flatnonzero(last > first)
            # a seed that many items share has many owners: all are met in arrays, HIT_BLOCK of them at a time
            ends = np.cumsum((last - first)[shared])
            for part in np.split(shared, np.searchsorted(ends, np.arange(HIT_BLOCK, ends[-1] if len(ends) else 0, HIT_BLOCK))):
                n = (last - first)[part]
                held = np.repeat(first[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(part) else part
                pairs = np.unique(np.stack((owners[held], np.repeat(at[part], n) - places[held]), 1), axis=0) if len(part) else ()
                found.update(map(tuple, pairs.tolist() if len(part) else ()))
        return found


def overlap(text: np.ndarray, item: np.ndarray, diagonal: int, substitutions: int) -> tuple[int, int]:
    """Longest aligned stretch along a diagonal with at most so many substituted tokens, and the longest with none."""
    start, end = max(0, -diagonal), min(len(item), len(text) - diagonal)
    differ = np.flatnonzero(text[start + diagonal : end + diagonal] != item[start:end])
    stops = np.concatenate(([-1], differ, [end - start]))
    near = [int((stops[k + 1 :] - stops[: -k - 1]).max()) - 1 if len(stops) > k + 1 else end - start for k in (substitutions, 0)]
    return near[0], near[1]


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, substitutions: int = 2, masks: Sequence[str] = MASKS) -> DataFrame:
    """``(doc_id, item_id, overlap_words, exact_words)`` of documents that hold a passage of an item.

    ``overlap_words`` is the longest aligned stretch, of at least ``min_words`` words, with at most
    ``substitutions`` words replaced; ``exact_words`` the longest without any difference. Every
    text is read whole, at every position. The masks must give a hit in every such stretch, whichever words
    are replaced, so that none is missed; settings for which they don't are refused. Items are broadcast in blocks of
    ``BLOCK_CHARS``, each searched over all documents; documents aren't shuffled. Texts that are
    null, empty or too short give no row. Items with equal texts are reported each. Repeated
    rows of a document or item give one row; columns not named aren't read.
    """
    if min_words < max(map(len, masks)):
        raise ValueError("min_words must be at least the span of the masks")
    if not bridged(masks, min_words, substitutions):
        raise ValueError("the masks miss some stretches of min_words with so many substitutions")
    spark = documents.sparkSession
    own = items.select("item_id", "text").dropna().distinct()
    size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_CHARS))
    texts, found = spread(documents.select("doc_id", "text")), None
    for block in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else own
        index = spark.sparkContext.broadcast(SeedIndex([(r[0], r[1]) for r in part.toLocalIterator()], masks))
        hits = texts.mapInArrow(_search(index, min_words, substitutions), "doc_id bigint, item_id bigint, overlap_words int, exact_words int")
        if blocks > 1:  # one block at a time is held by the driver and the executors
            hits = written(hits, "hits")
            index.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap_words").alias("overlap_words"), F.max("exact_words").alias("exact_words"))


def _search(index, min_words: int, substitutions: int):
    names = ["doc_id", "item_id", "overlap_words", "exact_words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: SeedIndex = index.value
        get = seeds.ids.get
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py() or "")
                if len(tokens) < min_words:
                    continue
                tokens = np.fromiter(map(get, tokens, repeat(0)), np.int64, len(tokens))
                best: dict[int, tuple[int, int]] = {}
                for k, diagonal in seeds.hits(tokens):
                    near, exact = overlap(tokens, seeds.items[k][1], diagonal, substitutions)
                    if near >= min_words:
                        old = best.get(k, (0, 0))
                        best[k] = (max(near, old[0]), max(exact, old[1]))
                rows += [(key, seeds.items[k][0], *lengths) for k, lengths in best.items()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return search

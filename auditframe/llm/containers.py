"""Filling containers of fixed capacity with texts, best fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import batched
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.runtime import spread, written

#: Where the public tokenizers' files lie.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pieces packed together: enough that the few containers left open at the end don't matter, and a bound on a task's state.
GROUP_PIECES = 20_000


#: Kinds of containers that one pass over the texts fills; more take more passes.
PASS_KINDS = 1000


def tokenizer(path: str = TOKENIZER):
    """The byte-level tokenizer whose ranks lie at ``path``."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of the whole texts; a null text has no tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(count, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


class OpenBins:
    """Open containers by the room left in them, under a segment tree that finds the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.made = capacity, 0

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.filled[node] += change
            node >>= 1

    def _tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that an open container has."""
        node = self.leaves + size
        if self.filled[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def put(self, size: int) -> int:
        """The number of the container that takes a piece of ``size``."""
        room = self._tightest(size)
        if room is None:
            room, number = self.capacity, self.made
            self.made += 1
        else:
            number = self.bins[room].pop()
            self._count(room, -1)
        if room > size:
            self.bins[room - size].append(number)
            self._count(room - size, 1)
        return number


def fill_containers(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(container_kind, container_id, doc_id, piece_no, first_token, n_tokens)``: a row for every piece of every text and kind.

    A text is cut only if it alone exceeds a kind's capacity, into pieces of exactly the
    capacity and a rest. Whole containers are closed at once; all other pieces are spread by
    hash over groups of about ``group_pieces``, as many as the kind has pieces for, and packed within them by best fit decreasing, so no
    task holds more than a group's open containers, and a group that grows beyond twice its
    size (equal ids) starts anew. Texts without tokens get a piece of size 0 in some container.
    Each kind is a task of its own, and ``PASS_KINDS`` are filled in a pass; a kind whose capacity is null or not positive, or an empty
    table, gives no rows. Rows with one doc_id are separate texts. Other columns aren't read.
    """
    sizes = written(count_tokens(documents, path), "token-counts")
    kinds = containers.select(F.col("container_kind").cast("string"), F.col("capacity_tokens").cast("bigint")).filter("capacity_tokens > 0").distinct()
    passes, found = batched(kinds.toLocalIterator(), PASS_KINDS), None
    for some in passes:
        part = _filled(sizes, sorted(map(tuple, some), key=str), group_pieces)
        found = part if found is None else found.unionByName(part)
    return _filled(sizes.limit(0), [("", 1)], group_pieces) if found is None else found


def _filled(sizes: DataFrame, kinds: list[tuple[str | None, int]], group_pieces: int) -> DataFrame:
    """The texts' pieces in containers of some kinds."""
    pieces_of = lambda c: F.sum(F.greatest(F.ceil(F.col("n_tokens") / c), F.lit(1)))
    counts = sizes.agg(*[pieces_of(capacity) for _, capacity in kinds]).first()
    each = F.array(*[
        F.struct(F.lit(kind).cast("string").alias("container_kind"), F.lit(capacity).cast("bigint").alias("capacity"), F.lit(max(1, -(-(n or 0) // group_pieces))).cast("bigint").alias("groups"))
        for (kind, capacity), n in zip(kinds, counts)
    ])
    cut = F.expr("transform(sequence(0, greatest((n_tokens - 1) div capacity, 0)), i -> struct(cast(i as int) as piece_no, i * capacity as first_token, least(capacity, n_tokens - i * capacity) as size))")
    tasks = sizes.select("doc_id", "n_tokens", F.explode(each).alias("k")).select("doc_id", "n_tokens", "k.*")
    pieces = tasks.select("container_kind", "capacity", "groups", "doc_id", F.explode(cut).alias("p")).select("container_kind", "capacity", "groups", "doc_id", "p.*")
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece_no", "size"), F.col("groups")).cast("int")).drop("groups")
    ordered = pieces.repartition("container_kind", "grp").sortWithinPartitions("container_kind", "capacity", "grp", F.desc("size"), "doc_id", "piece_no")
    kind = sizes.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(_pack(2 * group_pieces), f"container_kind string, container_id string, doc_id {kind}, piece_no int, first_token bigint, n_tokens bigint")


def _pack(most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins, taken, block = None, None, 0, 0
        for batch in batches:
            ids = []
            for kind, capacity, size, grp in zip(*(batch.column(c).to_pylist() for c in ("container_kind", "capacity", "size", "grp"))):
                if group != (kind, capacity, grp):
                    group, bins, taken, block = (kind, capacity, grp), OpenBins(capacity), 0, 0
                elif taken >= most:
                    bins, taken, block = OpenBins(capacity), 0, block + 1
                taken += 1
                ids.append(f"{kind}-{capacity}-{grp}-{block}-{bins.put(size)}")
            columns = [batch.column("container_kind"), pa.array(ids, pa.string()), *(batch.column(c) for c in ("doc_id", "piece_no", "first_token", "size"))]
            yield pa.RecordBatch.from_arrays(columns, ["container_kind", "container_id", "doc_id", "piece_no", "first_token", "n_tokens"])

    return pack

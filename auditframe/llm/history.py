"""Checking new batches for repeats of everything accepted before, at a cost that follows the batch."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.runtime import add_to_table, bucket_count, bucketed, own_folder, remove_folder, semi, small, spread, without, written

#: Words that may differ for each 100 words of the longer text.
DIFFER = 15

#: Signatures beyond those that are needed to share one; a pair has to share that many more.
SPARE = 3

#: Texts with one signature, up to which all of them are paired. A batch with larger groups is settled
#: in parts of growing size, as what the first part accepts settles most of such a group; a signature that is
#: still hot is refined by a second one.
HOT = 64
PART = 8

#: Texts with one signature, above which it counts as boilerplate and comes last in the order.
BOILERPLATE = 256

_WORD = re.compile(r"[^\W_]+")


def allowed(longer: int) -> int:
    """Differing words allowed for a longer text of so many words."""
    return DIFFER * longer // 100


def signature_count(n: int) -> int:
    """Of ``n + 2`` word triples, so many of the first in a fixed order meet ``SPARE + 1`` of any near text's.

    Each differing word spoils three triples; the longest near text has ``100 n / (100 - DIFFER)`` words.
    """
    return min(n + 2, 3 * allowed(100 * n // (100 - DIFFER)) + 1 + SPARE)


class Tokens(dict):
    """Word to a 63-bit number: its length above, its hash below; forgotten now and then to stay small."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = token = (min(len(word), 127) << 56) | (xxhash.xxh3_64_intdigest(word) & ((1 << 56) - 1))
        return token


def ordered_triples(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the text's triples of neighbouring words, each with its occurrence number: those of the longest words, which are the rarest, first."""
    padded = np.concatenate(([0, 0], tokens, [0, 0]))
    a, b, c = (padded[i : len(padded) - 2 + i].astype(np.uint64) for i in range(3))
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) ^ (c * np.uint64(0x94D049BB133111EB))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    lengths = padded >> 56
    order = np.lexsort((h, -(lengths[:-2] + lengths[1:-1] + lengths[2:])))
    h = h[order]
    # equal triples lie together: number them, so that a repeated one counts as often as it occurs
    fresh = np.concatenate(([True], h[1:] != h[:-1]))
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(h)]))))
        h = h + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return h.view(np.int64)


def signatures(tokens: np.ndarray) -> np.ndarray:
    """The first of the text's triples in their order: its signatures."""
    return ordered_triples(tokens)[: signature_count(len(tokens))]


def word_distance(a: list, b: list, most: int) -> int:
    """Words added, dropped or replaced between two sequences, bit-parallel; ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    m = len(a)
    if not m:
        return len(b)
    where: dict = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, word in enumerate(b):
        eq = where.get(word, 0)
        across = (((eq & up) + up) ^ up) | eq
        eq |= down
        plus, minus = down | (~(across | up) & full), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - (len(b) - j - 1) > most:
            return most + 1
        plus = ((plus << 1) | 1) & full
        minus = (minus << 1) & full
        up, down = minus | (~(eq | plus) & full), plus & eq
    return score


#: Bucketed tables of a history: columns, and the key by which each is bucketed and probed.
KINDS = {
    "contents": ("content_key binary, accepted bigint", "content_key"),
    "texts": ("text_key binary, accepted bigint", "text_key"),
    "tokens": ("text_id bigint, accepted bigint, tokens binary", "text_id"),
    "signatures": ("sig bigint, text_id bigint, n_words int", "sig"),
    "hot": ("sig bigint", "sig"),
}
_LOG = "no int, done boolean, version int, buckets int"


@dataclass(frozen=True)
class History:
    """What was accepted, in one bucketed table for each of ``KINDS`` below ``location``, as of ingest ``upto``.

    contents: hash of size and digest to the accepted entry; texts: hash of the word sequence to it; tokens: by
    text; signatures of accepted texts; hot: signatures that many texts share, by the ingest that found it.
    Every ingest appends to each table. Its rows count once the log below ``location`` says that
    it is done, so a driver that dies in between leaves nothing but rows that nobody reads. One
    writer at a time. A history at a location of the caller's stays there for later sessions.
    """

    location: str
    buckets: int
    version: int = 0
    upto: int = 0
    dropped: tuple[int, ...] = ()

    @staticmethod
    def create(spark: SparkSession, location: str | None = None, buckets: int | None = None) -> History:
        """An empty history; without a location it lies in the shared folder and goes when the driver ends."""
        history = History((location or own_folder(spark, "history")).rstrip("/"), buckets or bucket_count(spark))
        history._log(spark, 0, True)
        return history

    @staticmethod
    def open(spark: SparkSession, location: str) -> History:
        """The history at a location as the last ingest that was done left it."""
        rows = spark.read.schema(_LOG).parquet(f"{location.rstrip('/')}/log").collect()
        done = {r["no"]: r for r in rows if r["done"]}
        last = done[max(done)]
        return History(location.rstrip("/"), last["buckets"], last["version"], last["no"], tuple(sorted({r["no"] for r in rows if r["no"] < last["no"]} - set(done))))

    def _log(self, spark: SparkSession, no: int, done: bool) -> None:
        spark.createDataFrame([(no, done, self.version, self.buckets)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.location}/log")

    def table(self, spark: SparkSession, kind: str) -> str:
        """The table of a kind, known to this session's catalog."""
        columns, key = KINDS[kind]
        name = f"accepted_{kind}_{xxhash.xxh3_64_hexdigest(self.location)}_{self.version}"
        if not spark.catalog.tableExists(name):
            spark.sql(f"create table {name} ({columns}, ingest int) using parquet clustered by ({key}) into {self.buckets} buckets location '{self.location}/{kind}-{self.version}'")
        return name

    def rows(self, spark: SparkSession, kind: str) -> DataFrame:
        found = spark.table(self.table(spark, kind)).filter(F.col("ingest") <= self.upto)
        return found.filter(~F.col("ingest").isin(*self.dropped)) if self.dropped else found

    def probe(self, spark: SparkSession, kind: str, keys: DataFrame) -> DataFrame:
        """Rows of a kind whose key is among ``keys`` (one column, no repeats): the table is read once where it lies, only the keys are shuffled."""
        key = KINDS[kind][1]
        return self.rows(spark, kind).join(keys.toDF(key).hint("shuffle_hash"), key, "left_semi")

    def appended(self, spark: SparkSession, parts: Mapping[str, Sequence[tuple[DataFrame, bool]]]) -> History:
        """The history with rows appended to each kind; with True the rows lie in the table's buckets already and aren't shuffled."""
        seen = History.open(spark, self.location)
        if seen.upto != self.upto:
            raise ValueError(f"the history at {self.location} has been added to: open it again")
        tried = spark.read.schema(_LOG).parquet(f"{self.location}/log").agg(F.max("no")).first()[0]
        no = tried + 1
        self._log(spark, no, False)
        for kind, rows in parts.items():
            for df, placed in rows:
                df = df.withColumn("ingest", F.lit(no))
                add_to_table(df if placed else df.repartition(self.buckets, KINDS[kind][1]), self.table(spark, kind), self.buckets, KINDS[kind][1])
        self._log(spark, no, True)
        return replace(self, upto=no, dropped=(*self.dropped, *range(self.upto + 1, no)))

    def compacted(self, spark: SparkSession, buckets: int | None = None) -> History:
        """The history in new tables of one file a bucket, in ``buckets`` buckets if it has outgrown its own; the old tables are removed."""
        no = spark.read.schema(_LOG).parquet(f"{self.location}/log").agg(F.max("no")).first()[0] + 1
        found = replace(self, buckets=buckets or self.buckets, version=no, upto=no, dropped=())
        found._log(spark, no, False)
        for kind, (_, key) in KINDS.items():
            # the ingest of a hot signature is its rank among orders, so it is kept
            add_to_table(self.rows(spark, kind).repartition(found.buckets, key), found.table(spark, kind), found.buckets, key)
        found._log(spark, no, True)
        for kind in KINDS:
            spark.sql(f"drop table {self.table(spark, kind)}")
            remove_folder(spark, f"{self.location}/{kind}-{self.version}")
        return found


def _united(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _prepared(batch: DataFrame) -> DataFrame:
    """(entry_id, content_key, text_key, n_words, tokens): keys are 128-bit hashes, null where nothing is known to compare; tokens are 64-bit words."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for rows in batches:
            ids, sizes, digests, bodies = (rows.column(i).to_pylist() for i in range(4))
            content, text, counts, sequences = [], [], [], []
            for size, digest, body in zip(sizes, digests, bodies):
                content.append(None if size is None or digest is None else xxhash.xxh3_128_digest(f"{size}:{digest.lower()}"))
                if body is None:
                    text.append(None), counts.append(None), sequences.append(None)
                    continue
                seq = array("q", [tokens[w] for w in _WORD.findall(body.lower())])
                packed = seq.tobytes()
                text.append(xxhash.xxh3_128_digest(packed))
                counts.append(len(seq))
                sequences.append(packed)
            arrays = [rows.column(0), pa.array(content, pa.binary()), pa.array(text, pa.binary()), pa.array(counts, pa.int32()), pa.array(sequences, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["entry_id", "content_key", "text_key", "n_words", "tokens"])

    rows = batch.filter("entry_id is not null and not (size <=> 0)").select(F.col("entry_id").cast("bigint"), F.col("size").cast("bigint"), F.col("sha256").cast("string"), F.col("body").cast("string"))
    return spread(rows).mapInArrow(prepare, "entry_id bigint, content_key binary, text_key binary, n_words int, tokens binary")


#: Texts of fewer words have no near text but their equals.
_FEWEST = -(-100 // DIFFER) - 1


def _by_text(texts: DataFrame, make, columns: str) -> DataFrame:
    """Rows that ``make`` gives for each text ``(text_id, n_words, tokens, ...)``: arrays of the columns after those two."""
    names = [c.split()[0] for c in columns.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            more = [rows.column(i).to_pylist() for i in range(3, rows.num_columns)]
            made = [make(np.frombuffer(t.as_py(), np.int64), *x) for t, *x in zip(rows.column(2), *more)]
            sizes = np.array([len(m[0]) for m in made], np.int64)
            columns = [np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.int64) for i in range(len(names))]
            arrays = [pa.array(np.repeat(np.array(rows.column(i)), sizes)) for i in range(2)] + [pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["text_id", "n_words", *names])

    return texts.mapInArrow(sign, f"text_id bigint, n_words int, {columns}")


def _demoted(tokens: np.ndarray, hot: list[int], since: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a text with hot triples, by the order of each ingest that made one hot: (sig, own: by the newest order, extra: not by the first)."""
    all_of, count = ordered_triples(tokens), signature_count(len(tokens))
    rank = {h: s for h, s in zip(hot, since)}
    ranks = np.array([rank.get(h, 0) for h in all_of.tolist()], np.int64)
    first = set(all_of[:count].tolist())
    found: dict[int, bool] = {}
    for upto in sorted(set(rank.values())):
        last = (ranks > 0) & (ranks <= upto)
        newest = np.concatenate((all_of[~last], all_of[last]))[:count].tolist()
        found.update(dict.fromkeys(newest, False))
    found.update(dict.fromkeys(newest, True))
    sigs = [h for h, own in found.items() if own or h not in first]
    return np.array(sigs, np.int64), np.array([found[h] for h in sigs], np.bool_), np.array([h not in first for h in sigs], np.bool_)


@dataclass(frozen=True)
class Signed:
    """A batch's signatures: by the first order (``table``), of which several texts have those in ``crowds``, and of texts with hot ones (``moved``) by newer orders too (``again``)."""

    table: str
    crowds: DataFrame
    new_hot: DataFrame | None = None
    moved: DataFrame | None = None
    again: DataFrame | None = None

    def own(self, spark: SparkSession) -> list[tuple[DataFrame, bool]]:
        """Signatures by the newest order; True: they lie in their buckets."""
        rows = spark.table(self.table).select(*_SIG)
        if self.moved is None:
            return [(rows, True)]
        return [without(rows, self.moved, "text_id"), (self.again.filter("own").select(*_SIG), False)]

    def probing(self, spark: SparkSession) -> list[DataFrame]:
        """Signatures by all orders, as a text of the history has those of the order of its time."""
        rows = spark.table(self.table).select(*_SIG)
        return [rows] if self.again is None else [rows, self.again.filter("extra").select(*_SIG)]


_SIG = ("sig", "text_id", "n_words")


def _signed(texts: DataFrame, history: History) -> Signed:
    """Signatures of a batch's texts.

    A triple that more than ``BOILERPLATE`` texts have as a signature becomes hot, with all triples that so many of these texts share:
    boilerplate. Hot triples come last in the order, so that texts with a common notice are signed by what is their own.
    Any order serves as long as both texts of a pair are signed by it, so a text is looked up by the order of every
    ingest that made one of its triples hot.
    """
    spark = texts.sparkSession
    table = bucketed(_by_text(texts, lambda t: (signatures(t),), "sig bigint").select(*_SIG), "signatures", history.buckets, "sig")
    rows = spark.table(table)
    crowds = written(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "crowds")
    crowded = [crowds.filter(f"m > {BOILERPLATE}").select("sig")]
    if history.upto:
        keys = rows.select("sig").distinct()
        held = history.probe(spark, "signatures", keys).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
        crowded += [held.filter(f"n > {BOILERPLATE}").select("sig"), history.probe(spark, "hot", keys).select("sig")]
    crowded = written(_united(crowded).distinct(), "crowded")
    if not crowded.take(1):
        return Signed(table, crowds)
    triples = lambda ids: _by_text(texts.join(ids, "text_id", "left_semi").select("text_id", "n_words", "tokens"), lambda t: (ordered_triples(t),), "sig bigint")
    touched = written(rows.join(crowded, "sig", "left_semi").select("text_id").distinct(), "touched")
    common = triples(touched).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {BOILERPLATE}").select("sig")
    new_hot = written(crowded.unionByName(common).distinct().join(history.rows(spark, "hot").select("sig"), "sig", "left_anti"), "new-hot")
    moved = written(rows.join(new_hot, "sig", "left_semi").select("text_id").unionByName(touched).distinct(), "moved")
    hot = new_hot.select("sig", F.lit(2**31 - 1).alias("since")).unionByName(history.rows(spark, "hot").select("sig", F.col("ingest").alias("since")))
    # a text's own triples only, so no group is larger than a text
    marks = triples(moved).join(hot, "sig").groupBy("text_id").agg(F.collect_list("sig").alias("hot"), F.collect_list("since").alias("since"))
    again = _by_text(texts.join(marks, "text_id").select("text_id", "n_words", "tokens", "hot", "since"), _demoted, "sig bigint, own boolean, extra boolean")
    return Signed(table, crowds, new_hot, moved, written(again, "signed-again"))


def _near_lengths(x: str, y: str) -> str:
    return f"(100 * abs({x} - {y}) <= {DIFFER} * greatest({x}, {y}))"


def _needed(x: str, y: str) -> str:
    """Signatures that a near pair shares at least."""
    longer = f"greatest({x}, {y})"
    return f"least({SPARE + 1}, {longer} + 2 - 3 * ({DIFFER} * {longer} div 100))"


def _pairs(lower: DataFrame, upper: DataFrame, key: str, own: bool) -> DataFrame:
    a = lower.select(key, F.col("text_id").alias("a"), F.col("n_words").alias("na"))
    b = upper.select(key, F.col("text_id").alias("b"), F.col("n_words").alias("nb"))
    return a.join(b, key).filter(f"{'a < b' if own else 'a <> b'} and {_near_lengths('na', 'nb')}")


def _refined(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows of hot signatures, each with every other signature of its text as a second key: near texts share two at least."""
    others = signed.select("text_id", F.col("sig").alias("other"))
    return rows.join(others, "text_id").filter("sig <> other").select(F.xxhash64("sig", "other").alias("sig2"), "text_id", "n_words")


def _group_sizes(signed: DataFrame) -> DataFrame:
    return signed.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter(f"m > {HOT}")


def _counted(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many signatures as near texts do at least."""
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).filter(f"shared >= {_needed('na', 'nb')}").select("a", "b")


def _candidates(lower: DataFrame, upper: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of a batch's text ids, of which none that is near is missing.

    One table of signatures is paired with itself, each pair once, or accepted ones with new ones. ``hot``
    holds the signatures that may be hot still; those that are so on the lower side take a second signature as key.
    """
    own, upper = upper is None, lower if upper is None else upper
    if hot is not None:
        hot = written(_group_sizes(lower.join(hot, "sig", "left_semi")).select("sig"), "hot")
    if hot is None or not hot.take(1):
        return _counted(_pairs(lower, upper, "sig", own))
    cool, warm = (lambda rows: rows.join(hot, "sig", "left_anti")), (lambda rows: _refined(rows.join(hot, "sig", "left_semi"), rows))
    refined = _pairs(warm(lower), warm(upper), "sig2", own).select("a", "b")
    return _counted(_pairs(cool(lower), cool(upper), "sig", own)).unionByName(refined).distinct()


def _verified(pairs: DataFrame, lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``(a, b, accepted)``: the pairs whose word sequences differ by few enough words, counted exactly.

    Both sides are (text_id, tokens), the lower one with ``accepted`` of its text; the bucketed token tables stay where they lie.
    """
    met = pairs.join(lower.select(F.col("text_id").alias("a"), "accepted", F.col("tokens").alias("ta")), "a").join(upper.select(F.col("text_id").alias("b"), F.col("tokens").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            kept = []
            for x, y in zip(rows.column(3), rows.column(4)):
                x, y = (np.frombuffer(v.as_py(), np.int64).tolist() for v in (x, y))
                most = allowed(max(len(x), len(y)))
                kept.append(word_distance(x, y, most) <= most)
            yield rows.select(["a", "b", "accepted"]).filter(pa.array(kept, pa.bool_()))

    return met.select("a", "b", "accepted", "ta", "tb").mapInArrow(verify, "a bigint, b bigint, accepted bigint")


def _lowest(nodes: DataFrame, classes: DataFrame, copies: DataFrame, same: DataFrame, near: DataFrame) -> DataFrame:
    """(node, entry_a) of the nodes that repeat an accepted entry: ``copies`` by content, ``same`` by text, ``near`` (b, accepted) by words."""
    near = near.join(classes.select(F.col("text_id").alias("b"), "text_key"), "b").select("text_key", "accepted")
    found = nodes.join(copies, "content_key").select("node", "accepted").unionByName(nodes.join(same.unionByName(near), "text_key").select("node", "accepted"))
    return found.groupBy("node").agg(F.min("accepted").alias("entry_a"))


def _known(nodes: DataFrame, classes: DataFrame, texts: DataFrame, signed: Signed, history: History) -> DataFrame:
    """(node, entry_a) of the nodes that repeat an entry of the history.

    The history's tables are read where they lie and nothing of them is shuffled but what meets
    the batch: contents and texts by hash, signatures that the batch has too, tokens of candidates.
    """
    spark = nodes.sparkSession
    keys = lambda c: nodes.filter(F.col(c).isNotNull()).select(c).distinct()
    copies, same = (history.probe(spark, kind, keys(c)).select(c, "accepted") for kind, c in (("contents", "content_key"), ("texts", "text_key")))
    sought = _united(signed.probing(spark))
    held = written(history.probe(spark, "signatures", sought.select("sig").distinct()), "held-signatures")
    met = written(_counted(_pairs(held, sought, "sig", False)), "met-texts")
    tokens = history.probe(spark, "tokens", met.select("a").distinct())
    near = _verified(met, tokens, texts)
    return _lowest(nodes, classes, copies, same, near)


def _settled(nodes: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """(node, entry_a): entry_a is the accepted node that it repeats, null if it is accepted itself.

    ``nodes`` are in groups (equal contents, equal texts), ``near`` pairs groups of texts. In
    each round a node with no undecided or accepted lower node in sight is accepted, and one that
    sees an accepted lower node repeats it; only a group's lowest node still standing is looked at, so no
    group's pairs are formed. Rounds run on the few nodes that see another one. What a refused node
    repeats is read from the final state, as a lower node may be accepted after a higher one it sees.
    """
    text_group, content_group = F.struct(F.lit(0).alias("kind"), F.col("text_key").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("content_key").alias("key"))
    member = nodes.select("node", F.explode(F.filter(F.array(F.when(F.col("text_key").isNotNull(), text_group), F.when(F.col("content_key").isNotNull(), content_group)), lambda x: x.isNotNull())).alias("grp"))
    text_of = classes.select("text_id", "text_key")
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y")))
    seen = both.join(text_of.select(F.col("text_id").alias("x"), F.col("text_key").alias("own")), "x").join(text_of.select(F.col("text_id").alias("y"), F.col("text_key").alias("other")), "y")
    # a node sees its own groups of two and more, and the groups near its text
    crowded = member.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("grp")
    views = member.join(crowded, "grp").select("node", "grp")
    nearby = nodes.select("node", "text_key").join(seen.select(F.col("own").alias("text_key"), F.struct(F.lit(0).alias("kind"), F.col("other").alias("key")).alias("grp")), "text_key").select("node", "grp")
    views = written(views.unionByName(nearby), "views")
    if not views.take(1):
        return nodes.select("node", F.lit(None).cast("bigint").alias("entry_a"))
    member = written(member.join(views.select("grp").distinct(), "grp", "left_semi").select("node", "grp"), "members")
    state = views.select("node").distinct().select("node", F.lit(None).cast("bigint").alias("entry_a"), F.lit(False).alias("done"))
    while True:
        standing = state.filter("entry_a is null")
        heads = member.join(standing, "node").groupBy("grp").agg(F.min(F.struct("node", "done")).alias("head"))
        sight = views.join(heads, "grp").filter("head.node < node").groupBy("node").agg(
            F.min(F.when(F.col("head.done"), F.col("head.node"))).alias("accepted"), F.max(~F.col("head.done")).alias("open")
        )
        seen_now = state.join(sight, "node", "left")
        settled = F.col("done") & F.col("entry_a").isNull()
        state = written(
            seen_now.select(
                "node", F.when(~settled, F.coalesce("accepted", "entry_a")).alias("entry_a"), (F.col("done") | F.col("accepted").isNotNull() | ~F.coalesce("open", F.lit(False))).alias("done")
            ),
            "state",
        )
        if not state.filter("not done").take(1):
            break
    heads = member.join(state.filter("entry_a is null"), "node").groupBy("grp").agg(F.min("node").alias("head"))
    lowest = views.join(heads, "grp").filter("head < node").groupBy("node").agg(F.min("head").alias("entry_a"))
    return nodes.select("node").join(lowest, "node", "left")


_KEYS = ("content_key", "text_key")


def _same_keys():
    """Entries meet their node by both keys, nulls being equal; entries without any key are their own nodes."""
    same = F.lit(True)
    for c in _KEYS:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    return same & (F.col("content_key").isNotNull() | F.col("text_key").isNotNull())


def _parts(nodes: DataFrame, hot: DataFrame) -> list[tuple[int | None, int | None]]:
    """Ranges (above, up to) of nodes, one unless a signature is hot: then each holds ``PART`` times as much as all before it."""
    most, levels, cuts = hot.agg(F.max("m")).first()[0] or 0, 0, []
    while most > HOT * PART**levels:
        levels += 1
    if levels:
        shares = [PART**-k for k in range(levels, 0, -1)]
        cuts = sorted(set(nodes.agg(F.percentile_approx("node", shares, 100_000)).first()[0] or []))
    return list(zip([None, *cuts], [*cuts, None]))


def _shared(signed: Signed, spark: SparkSession, buckets: int) -> DataFrame:
    """Signatures by the newest order, without most of those that one text alone has: few of all."""
    rows = spark.table(signed.table)
    if signed.moved is None:
        return spark.table(bucketed(semi(rows, signed.crowds.select("sig"), "sig"), "shared_signatures", buckets, "sig", placed=small(signed.crowds.select("sig"))))
    again = signed.again.filter("own").select(*_SIG)
    sought = written(signed.crowds.select("sig").unionByName(again.select("sig")).distinct(), "sought")
    stayed, _ = without(semi(rows, sought, "sig"), signed.moved, "text_id")
    return spark.table(bucketed(stayed.unionByName(again), "shared_signatures", buckets, "sig"))


def _fresh(nodes: DataFrame, classes: DataFrame, texts: DataFrame, signed: Signed, buckets: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Of nodes that the history doesn't settle (``whole``: all of the batch): ``(node, entry_a)``, null if it is accepted, and the accepted ones as ``(node, content_key, text_key)``."""
    spark = nodes.sparkSession
    shared = _shared(signed, spark, buckets)
    hot = written(_group_sizes(shared), "hot-signatures")
    parts = _parts(nodes, hot)
    hot = hot.select("sig") if hot.take(1) else None
    of_texts = lambda some: semi(shared, written(classes.join(some.select("text_key").distinct(), "text_key", "left_semi").select("text_id"), "text-ids"), "text_id")
    tokens = texts.select("text_id", F.lit(None).cast("bigint").alias("accepted"), "tokens")
    fates, standing = [], []
    for above, upto in parts:
        part = nodes if above is None else nodes.filter(F.col("node") > above)
        part = part if upto is None else part.filter(F.col("node") <= upto)
        if standing:
            known = _united(standing)
            accepted = known.filter("text_key is not null").groupBy("text_key").agg(F.min("node").alias("accepted"))
            of = classes.join(accepted, "text_key").select("text_id", "accepted")
            near = _verified(_candidates(of_texts(known), of_texts(part), hot), texts.join(of, "text_id").select("text_id", "accepted", "tokens"), texts)
            copies = known.filter("content_key is not null").groupBy("content_key").agg(F.min("node").alias("accepted"))
            matched = written(_lowest(part, classes, copies, accepted, near), "matched")
            fates.append(matched)
            part = written(part.join(matched, "node", "left_anti"), "part")
        pairs = _verified(_candidates(shared if len(parts) == 1 and whole else of_texts(part), None, hot), tokens, texts)
        settled = written(_settled(part, classes, pairs.select("a", "b")), "settled")
        fates.append(settled)
        standing.append(written(part.join(settled.filter("entry_a is null"), "node", "left_semi").select("node", *_KEYS), "standing"))
    return _united(fates), _united(standing)


def ingest(batch: DataFrame, history: History | None = None, keep: bool = True) -> tuple[DataFrame, History]:
    """``(entry_a, entry_b)`` of the batch's repeats, and the history with the batch's accepted entries appended.

    ``batch``: entry_id (above all earlier ones), size, sha256, body. An entry is accepted
    unless it repeats an accepted one: size and digest known and equal (letter case aside), or
    both with bodies whose word sequences are equal or differ by at most ``DIFFER`` words per 100 of
    the longer. Full copies meet by hash. Near texts meet by signatures of word triples, of which near
    texts share some for certain; candidates are then compared word by word. Entries of size
    0 are left out; an entry with neither digest and size nor body repeats nothing. Bodies
    without words equal each other. A repeated entry_id is one entry. An empty batch
    gives no rows. Other columns aren't read. Without ``keep`` nothing is appended.
    """
    spark = batch.sparkSession
    history = history or History.create(spark)
    entries = spark.table(bucketed(_prepared(batch), "entries", history.buckets, "entry_id"))
    keyed = entries.select("entry_id", *_KEYS, "n_words")
    classes = written(keyed.filter("text_key is not null").groupBy("text_key", "n_words").agg(F.min("entry_id").alias("text_id")), "classes")
    # a repeated entry_id may have rows with other bodies: the key tells which of them is the text
    mine = classes.select("text_id", F.col("text_key").alias("key"))
    # compared as an array's member: a second key of the join would move the entries out of their buckets
    texts = entries.join(mine, entries.entry_id == F.col("text_id")).filter(F.array_contains(F.array("key"), F.col("text_key"))).select(F.col("entry_id").alias("text_id"), "n_words", "tokens")
    signed = _signed(texts.filter(f"n_words >= {_FEWEST}"), history)
    lone = F.when(F.col("content_key").isNull() & F.col("text_key").isNull(), F.col("entry_id")).alias("lone")
    nodes = fresh = written(keyed.groupBy(*_KEYS, lone).agg(F.min("entry_id").alias("node")).drop("lone"), "nodes")
    fates = []
    if history.upto:
        fates.append(written(_known(nodes, classes, texts, signed, history), "known"))
        fresh = written(nodes.join(fates[0], "node", "left_anti"), "fresh")
    settled, standing = _fresh(fresh, classes, texts, signed, history.buckets, not fates)
    owners = keyed.join(nodes.select("node", *[F.col(c).alias(f"n_{c}") for c in _KEYS]), _same_keys())
    repeats = owners.join(_united([*fates, settled]), "node").select(F.coalesce("entry_a", "node").alias("entry_a"), F.col("entry_id").alias("entry_b")).filter("entry_a < entry_b").distinct()
    if not keep:
        return repeats, history
    accepted = standing.filter("text_key is not null").groupBy("text_key").agg(F.min("node").alias("accepted"))
    ids = written(classes.join(accepted, "text_key").select("text_id", "text_key", "accepted"), "accepted-texts")
    parts = {
        "contents": [(standing.filter("content_key is not null").select("content_key", F.col("node").alias("accepted")), False)],
        "texts": [(ids.select("text_key", "accepted"), False)],
        "tokens": [(texts.join(ids.select("text_id", "accepted"), "text_id").select("text_id", "accepted", "tokens"), False)],
        "signatures": [(semi(df, ids.select("text_id"), "text_id"), placed and small(ids.select("text_id"))) for df, placed in signed.own(spark)],
        "hot": [] if signed.new_hot is None else [(signed.new_hot, False)],
    }
    return written(repeats, "repeats"), history.appended(spark, parts)


def replay(intake: DataFrame, buckets: int | None = None) -> DataFrame:
    """All repeats of a delivered history: the backlog as one batch, then the newest batch against what it left."""
    spark = intake.sparkSession
    last = intake.agg(F.max("batch_no").alias("n")).first()["n"]
    start = intake.filter(F.col("batch_no") == F.lit(last)).agg(F.min("entry_id").alias("i")).first()["i"]
    newer = F.coalesce(F.col("entry_id") >= F.lit(start), F.lit(False))
    backlog, history = ingest(intake.filter(~newer), History.create(spark, buckets=buckets))
    return backlog.unionByName(ingest(intake.filter(newer), history, keep=False)[0])

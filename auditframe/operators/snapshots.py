"""What changed between full snapshots that are delivered periodically."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.runtime import add_to_table, bucket_count, bucketed, own_folder, remove_folder, small_side, written

_KEY = ("root_name", "path")


_LOG = "version int, buckets int"


@dataclass(frozen=True)
class SnapshotIndex:
    """Bucketed table (root_name, path, snapshot_no, value_hash): the last snapshot of every root.

    At a ``location`` of the caller's it outlives the session; the log there names the version that holds.
    """

    table: str
    location: str | None = None
    version: int = 0

    @staticmethod
    def open(spark: SparkSession, location: str) -> SnapshotIndex:
        """The index that the last swap left at a location."""
        version, buckets = spark.read.schema(_LOG).parquet(f"{location}/log").agg(F.max(F.struct("version", "buckets")).alias("x")).select("x.*").first()
        index = SnapshotIndex(_table_name(location, version), location, version)
        if not spark.catalog.tableExists(index.table):
            spark.sql(f"create table {index.table} (root_name string, path string, snapshot_no int, value_hash bigint) using parquet clustered by ({', '.join(_KEY)}) into {buckets} buckets location '{location}/v{version}'")
        return index

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def drop(self, spark: SparkSession) -> None:
        spark.sql(f"drop table if exists {self.table}")
        if self.location:
            remove_folder(spark, f"{self.location}/v{self.version}")


def _table_name(location: str, version: int) -> str:
    return f"snapshot_index_{zlib.crc32(location.encode()):08x}_{version}"


def hashed_rows(rows: DataFrame) -> DataFrame:
    """(root_name, path, snapshot_no, recorded_at, value_hash); the hash tells null from every value."""
    parts = [x for c in ("size", "sha256") for x in (F.col(c).isNull(), F.col(c))]
    return rows.select(*_KEY, "snapshot_no", "recorded_at", F.xxhash64(*parts).alias("value_hash"))


def _holding(rows: DataFrame) -> DataFrame:
    """Of rows with one (root, snapshot, path), that with the latest recorded_at (null first; ties: the greatest hash)."""
    by_path = Window.partitionBy(*_KEY).orderBy("snapshot_no", F.col("recorded_at").asc_nulls_first(), "value_hash")
    following = F.lead("snapshot_no").over(by_path)
    return rows.withColumn("following", following).filter("following is null or following <> snapshot_no").drop("following")


def _calendar(rows: DataFrame) -> DataFrame:
    """(root_name, snaps): the snapshot numbers of each root, ascending."""
    return rows.groupBy("root_name").agg(F.array_sort(F.collect_set("snapshot_no")).alias("snaps"))


def _within(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots inside one batch: one shuffle by path, and no group larger than a path's history.

    Only a path's first and last row of an unbroken run need the calendar, so only those join it.
    """
    by_path = Window.partitionBy(*_KEY).orderBy("snapshot_no")
    seen = _holding(rows).select(
        *_KEY, "snapshot_no", "value_hash",
        F.lag("snapshot_no").over(by_path).alias("before"), F.lag("value_hash").over(by_path).alias("old"),
        F.lead("snapshot_no").over(by_path).alias("after"),
    )
    steady = "before <=> snapshot_no - 1 and after <=> snapshot_no + 1 and value_hash = old"
    edges = seen.filter(f"not ({steady})").join(calendar, "root_name")
    at = F.array_position("snaps", F.col("snapshot_no")).cast("int")
    edges = edges.withColumn("prior", F.get("snaps", at - 2)).withColumn("later", F.get("snaps", at))
    found = F.expr(
        "filter(array("
        "case when prior is null then null when not (before <=> prior) then struct(snapshot_no as no, 'added' as kind)"
        " when value_hash <> old then struct(snapshot_no as no, 'changed' as kind) end,"
        "case when later is not null and not (after <=> later) then struct(later as no, 'removed' as kind) end"
        "), x -> x is not null)"
    )
    return edges.select("root_name", "path", F.explode(found).alias("x")).select("root_name", F.col("x.no").alias("snapshot_no"), "path", F.col("x.kind").alias("change_kind"))


def _known_roots(first: DataFrame, index: SnapshotIndex) -> DataFrame:
    """(r, first_no) of the delivered roots that the index knows: only their paths can be added or removed."""
    known = index.rows(first.sparkSession).select(F.col("root_name").alias("r")).distinct()
    return small_side(first.join(known, "r", "left_semi"), "roots")


def _against_index(rows: DataFrame, roots: DataFrame, index: SnapshotIndex) -> DataFrame:
    """Changes of each known root's first delivered snapshot, which ``rows`` hold alone, against the index, which isn't shuffled."""
    fresh = _holding(rows).select(*_KEY, F.col("snapshot_no").alias("new_no"), F.col("value_hash").alias("new"))
    held = index.rows(rows.sparkSession).select(*_KEY, F.col("snapshot_no").alias("old_no"), F.col("value_hash").alias("old"))
    met = held.join(fresh, list(_KEY), "full_outer").filter("not (old <=> new)")
    return met.join(roots, F.col("root_name") == F.col("r")).select(
        "root_name", F.col("first_no").alias("snapshot_no"), "path",
        F.expr("case when old_no is null then 'added' when new_no is null then 'removed' else 'changed' end").alias("change_kind"),
    )


def snapshot_changes(batch: DataFrame, index: SnapshotIndex | None = None) -> DataFrame:
    """``(root_name, snapshot_no, path, change_kind)``: ``added``, ``removed`` or ``changed``.

    ``batch`` holds one or more whole snapshots per root (root_name, snapshot_no, recorded_at,
    path, size, sha256). Each is compared with the next lower snapshot number present, the
    first of the batch with the ``index`` of the last one delivered earlier; a root's first
    snapshot ever gives nothing. Of a repeated path the row with the latest recorded_at
    holds. A null size or digest differs from any value and equals null. Rows without root,
    number or path are left out, as they belong to no snapshot. An empty
    batch gives no changes. Further columns aren't read.
    """
    rows = hashed_rows(batch.dropna(subset=["root_name", "snapshot_no", "path"]))
    calendar = small_side(_calendar(rows), "calendar")
    found = _within(rows, calendar)
    if index is not None:
        first = calendar.select(F.col("root_name").alias("r"), F.col("snaps")[0].alias("first_no"))
        roots, starts = _known_roots(first, index), (F.col("root_name") == F.col("r")) & (F.col("snapshot_no") == F.col("first_no"))
        found = found.unionByName(_against_index(rows.join(first, starts, "left_semi"), roots, index))
    return found


def next_index(batch: DataFrame, index: SnapshotIndex | None = None, location: str | None = None, last: DataFrame | None = None) -> SnapshotIndex:
    """The index after ``batch``, to be swapped in for ``index``: roots not delivered keep their entries.

    It lies at the location given or that of ``index``, else in the shared folder until the driver ends. ``last`` has
    the last snapshot (r, last_no) of each delivered root, if that is known already.
    """
    rows = hashed_rows(batch.dropna(subset=["root_name", "snapshot_no", "path"]))
    if last is None:
        last = small_side(rows.groupBy(F.col("root_name").alias("r")).agg(F.max("snapshot_no").alias("last_no")), "last")
    kept = _holding(rows.join(last, (F.col("root_name") == F.col("r")) & (F.col("snapshot_no") == F.col("last_no"))))
    kept = kept.select(*_KEY, "snapshot_no", "value_hash")
    if index is not None:
        kept = kept.unionByName(index.rows(batch.sparkSession).join(last, F.col("root_name") == F.col("r"), "left_anti"))
    spark, location = batch.sparkSession, location or (index and index.location)
    buckets = bucket_count(spark)
    if not location:
        return SnapshotIndex(bucketed(kept, "snapshot_index", buckets, *_KEY))
    location, version = location.rstrip("/"), index.version + 1 if index else 1
    swapped = SnapshotIndex(_table_name(location, version), location, version)
    swapped.drop(spark)  # what an attempt that failed may have left
    add_to_table(kept.select(*_KEY, "snapshot_no", "value_hash").repartition(buckets, *_KEY), swapped.table, buckets, *_KEY, path=f"{location}/v{version}")
    spark.createDataFrame([(version, buckets)], _LOG).coalesce(1).write.mode("append").parquet(f"{location}/log")
    return swapped


def changed_values(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new size and digest, fetched for the changed paths only; either side holds one snapshot of a root, and of a repeated path the same row as above."""
    some = changes.filter("change_kind = 'changed'").select("root_name", "snapshot_no", "path")

    def values(rows: DataFrame, side: str) -> DataFrame:
        parts = [x for c in ("size", "sha256") for x in (F.col(c).isNull(), F.col(c))]
        by = Window.partitionBy(*_KEY).orderBy(F.col("recorded_at").desc_nulls_last(), F.xxhash64(*parts).desc())
        wanted = rows.join(some.select(*_KEY), list(_KEY), "left_semi")
        return wanted.withColumn("n", F.row_number().over(by)).filter("n = 1").select(*_KEY, F.struct("size", "sha256").alias(side))

    return some.join(values(before, "old_value"), list(_KEY)).join(values(after, "new_value"), list(_KEY))


def _dealt(snapshots: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The history as deliveries, each in its own folder: the first snapshot of every root, the second, and so on; with (r, first_no) of the roots delivered."""
    rows = snapshots.select(*_KEY, "snapshot_no", "recorded_at", "size", "sha256").dropna(subset=["root_name", "snapshot_no", "path"])
    numbers = rows.select(F.col("root_name").alias("r"), F.col("snapshot_no").alias("no")).distinct()
    turns = small_side(numbers.withColumn("turn", F.row_number().over(Window.partitionBy("r").orderBy("no"))), "turns")
    most = turns.agg(F.max("turn")).first()[0] or 0
    path = own_folder(rows.sparkSession, "deliveries")
    rows.join(turns, (F.col("root_name") == F.col("r")) & (F.col("snapshot_no") == F.col("no"))).drop("r", "no").write.partitionBy("turn").parquet(path)
    for turn in range(1, most + 1):
        yield rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/turn={turn}"), turns.filter(F.col("turn") == turn).select("r", F.col("no").alias("first_no"))


def _replayed(snapshots: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(changes, before, after) of each delivery: it is probed against the index, and the index is then swapped for the next.

    A root's second delivery and all after it are of a root that the index knows.
    """
    index, before = None, None
    for batch, roots in _dealt(snapshots):
        if index is not None:
            yield written(_against_index(hashed_rows(batch), roots, index), "changes"), before, batch
        old, index, before = index, next_index(batch, index, last=roots.withColumnRenamed("first_no", "last_no")), batch
        if old is not None:
            old.drop(batch.sparkSession)


def replay(snapshots: DataFrame) -> DataFrame:
    """All changes of a delivered history, delivery by delivery against the swapped index."""
    found = snapshots.sparkSession.createDataFrame([], "root_name string, snapshot_no int, path string, change_kind string")
    for changes, _, _ in _replayed(snapshots):
        found = found.unionByName(changes)
    return found


def replay_values(snapshots: DataFrame) -> DataFrame:
    """``(root_name, snapshot_no, path, old_size, old_sha256, new_size, new_sha256)`` of all changed paths of a delivered history."""
    values = "root_name", "snapshot_no", "path", *(F.col(f"{side}_value.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("size", "sha256"))
    found = snapshots.sparkSession.createDataFrame([], "root_name string, snapshot_no int, path string, old_size bigint, old_sha256 string, new_size bigint, new_sha256 string")
    for changes, before, after in _replayed(snapshots):
        found = found.unionByName(written(changed_values(changes, before, after).select(*values), "values"))
    return found

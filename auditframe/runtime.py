"""Session helpers: the shared work folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in memory up to which a side table may be broadcast: measured, it bounds what reaches an executor.
BROADCAST_BYTES = 8 << 20


#: Folders written by this driver, removed when it ends; ``released`` removes them earlier.
_WRITTEN: list[tuple[SparkSession, str]] = []


def remove_folder(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


@atexit.register
def released() -> None:
    """Remove all intermediate tables; results not yet read from them can't be read any more."""
    while _WRITTEN:
        remove_folder(*_WRITTEN.pop())


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be removed in the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``, else a local one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="auditframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives executors."""
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str, placed: bool = False) -> str:
    """Write ``df`` as a table bucketed by ``keys`` in the shared folder; the table's name.

    ``placed`` rows lie in such buckets already and aren't shuffled.
    """
    path = own_folder(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    add_to_table(df if placed else df.repartition(buckets, *keys), table, buckets, *keys, path=path)
    return table


def add_to_table(placed: DataFrame, table: str, buckets: int, *keys: str, path: str | None = None) -> None:
    """Append rows that lie in the table's buckets already. Keys and ids are hashes mostly, for which dictionaries are wasted work."""
    writer = placed.write.mode("append").format("parquet").option("parquet.enable.dictionary", "false").bucketBy(buckets, *keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def memory_bytes(df: DataFrame) -> int:
    """Bytes that the rows take in memory, about: 8 for a fixed value, and the length of each string, binary and array."""
    size = F.lit(16)
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        size = size + (F.coalesce(F.octet_length(column), F.lit(0)) + 16 if kind in ("string", "binary") else F.greatest(F.size(column), F.lit(0)) * 8 + 32 if kind == "array" else F.lit(8))
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table that is written already may be broadcast."""
    return memory_bytes(df) <= limit


def small_side(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written out, with a broadcast hint if it takes at most ``limit`` bytes; else left to sort-merge."""
    kept = written(df, name)
    return F.broadcast(kept) if small(kept, limit) else kept


def semi(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` whose key is among the written ``ids``: where they lie if the ids can be broadcast, else by a shuffle."""
    return df.join(F.broadcast(ids) if small(ids, limit) else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Rows of ``df`` whose key isn't among the written ``ids``, and whether they lie where they lay."""
    stays = small(ids, limit)
    return df.join(F.broadcast(ids) if stays else ids, key, "left_anti"), stays


def spread(df: DataFrame) -> DataFrame:
    """A scan for work that costs much more than reading: shared out anew if it has fewer partitions than there are cores.

    Only inputs too small to be split are shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table: as many as shuffles have partitions, so that it grows with the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_auditframe_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="auditframe-")) / "auditframe-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._auditframe_shipped = True

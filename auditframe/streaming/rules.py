"""The row rules on streams: stateless parsing, and repeats within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import rejects
from auditframe.runtime import own_folder


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder; of a path that is one file, that file of its folder."""
    now = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    one = [f.rstrip("/").rsplit("/", 1)[1] for f in now.inputFiles()] == [name]
    return spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name if one else "*.parquet").parquet(folder if one else path)


def rejected_stream(records: DataFrame) -> DataFrame:
    """``(line_id, reason)`` of a stream of raw records; no state is kept."""
    return rejects.rejected(rejects.parse_events(records))


def first_seen(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Events without those that repeat their keys within ``delay``; the state is bounded by the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has so far, written once to the shared folder and read back."""
    spark = stream.sparkSession
    folder = own_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*[F.col(c) for c in stream.columns])

"""Lines of text files with their exact numbers, however the files are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """``(file, line, content)``: lines end at LF, CRLF or CR and count from 1 in each file.

    A file's splits count their lines in a small aggregate; a line's number is the sum of the splits
    before its own and its place there. A byte-order mark at a file's start is no content.
    """
    lines = spark.read.text([str(p) for p in paths]).select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", "first", before.alias("before"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "content")

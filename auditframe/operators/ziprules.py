"""Extraction hazards in the central directories of any number of ZIP archives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import config
from auditframe.functions.columns import is_ascii
from auditframe.functions.python import casefold
from auditframe.operators.issues import IssueKind, first_holders
from auditframe.runtime import written

ENTRY_SCHEMA = "archive string, entry_index bigint, name string, is_dir boolean, compress_size bigint, file_size bigint, external_attr bigint, flag_bits int"

KIND = IssueKind({
    "entry_index": "bigint", "path": "string", "first_entry_index": "bigint", "first_path": "string", "actual_bytes": "decimal(38,0)", "maximum_bytes": "bigint",
    "actual_ratio": "double", "maximum_ratio": "double", "reason": "string",
})

_PATH = ("entry_index", "path")
DETAILS = {code: _PATH for code in ("invalid_path", "absolute_or_drive_path", "backslash_path", "parent_traversal", "non_normalized_path", "symlink_entry", "encrypted_entry")} | {
    "duplicate_path": (*_PATH, "first_entry_index"), "normalized_path_collision": (*_PATH, "first_path", "first_entry_index"), "case_collision": (*_PATH, "first_path", "first_entry_index"),
    "entry_too_large": (*_PATH, "actual_bytes", "maximum_bytes"), "compression_ratio_exceeded": (*_PATH, "actual_ratio", "maximum_ratio", "reason"), "archive_too_large": ("actual_bytes", "maximum_bytes"),
}


@dataclass(frozen=True)
class ZipRules:
    max_entry_bytes: int = 100 * 1024 * 1024
    max_total_bytes: int = 1024 * 1024 * 1024
    max_ratio: float = 100.0

    def __post_init__(self) -> None:
        config.positive_int("max_entry_uncompressed_bytes", self.max_entry_bytes)
        config.positive_int("max_total_uncompressed_bytes", self.max_total_bytes)
        config.positive_number("max_compression_ratio", self.max_ratio)


def hazards(entries: DataFrame) -> DataFrame:
    """Entries with a flag for each path hazard, ``safe``, and the canonical path of the safe ones. A null name is empty."""
    name = F.coalesce(F.col("name"), F.lit(""))
    translated = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    parts = F.split(F.regexp_replace(translated, r"/\z", ""), "/", -1)
    nothing = translated.isin("", "/")
    own = [F.col(c) for c in ("archive", "entry_index", "is_dir", "compress_size", "file_size", "external_attr", "flag_bits")]
    rows = entries.select(*own, name.alias("name"))
    name = F.col("name")
    rows = rows.select(
        "*", ((name == "") | name.contains("\0")).alias("invalid_path"), name.rlike(r"(?s)\A(?:[/\\]|.:)").alias("absolute_or_drive_path"), name.contains("\\").alias("backslash_path"),
        (~nothing & F.array_contains(parts, "..")).alias("parent_traversal"), (nothing | F.arrays_overlap(parts, F.array(F.lit(""), F.lit(".")))).alias("non_normalized_path"), F.array_join(parts, "/").alias("canonical"),
    )
    unsafe = F.col("invalid_path") | F.col("absolute_or_drive_path") | F.col("backslash_path") | F.col("parent_traversal") | F.col("non_normalized_path")
    return rows.withColumn("safe", ~unsafe)


def collisions(flagged: DataFrame) -> DataFrame:
    """``(archive, entry_index, first_path, first_entry_index, collision)`` of safe entries whose folded path another name holds first.

    The first holder of each folded path is found by aggregation, so archives of any size and
    any number of colliding entries are shared out by path.
    """
    safe = flagged.filter("safe").select("archive", "entry_index", "name", "canonical")
    # names beyond ASCII are rare: only those leave the JVM
    safe = safe.filter(is_ascii(F.col("canonical"))).withColumn("folded", F.lower("canonical")).unionByName(safe.filter(~is_ascii(F.col("canonical"))).withColumn("folded", casefold(F.col("canonical"))))
    crowded = safe.groupBy("archive", "folded").agg(F.min(F.struct("entry_index", "name", "canonical")).alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = safe.join(crowded, ["archive", "folded"]).filter("holder.name <> name")
    kind = F.when(F.col("holder.canonical") == F.col("canonical"), "normalized_path_collision").otherwise("case_collision")
    return met.select("archive", "entry_index", F.col("holder.name").alias("first_path"), F.col("holder.entry_index").alias("first_collision_index"), kind.alias("collision"))


def zip_issues(entries: DataFrame, rules: ZipRules) -> DataFrame:
    """All issues of all archives."""
    flagged = written(hazards(entries), "zip-entries")
    firsts = first_holders(flagged, ["archive", "name"], "entry_index").withColumnRenamed("first_line", "first_index")
    rows = flagged.join(firsts, ["archive", "name"], "left").join(collisions(flagged), ["archive", "entry_index"], "left")
    own = {"entry_index": F.col("entry_index"), "path": F.col("name")}
    size, packed = F.col("file_size"), F.col("compress_size")
    file = ~F.col("is_dir")
    ratio = F.when(packed > 0, size / packed)
    codes = ("invalid_path", "absolute_or_drive_path", "backslash_path", "parent_traversal", "non_normalized_path")
    issues = [KIND.one(F.col(code), code, k, **own) for k, code in enumerate(codes)]
    issues.append(KIND.one(F.col("first_index") < F.col("entry_index"), "duplicate_path", 5, first_entry_index=F.col("first_index"), **own))
    for code in ("normalized_path_collision", "case_collision"):
        issues.append(KIND.one(F.col("collision") == code, code, 6, first_path=F.col("first_path"), first_entry_index=F.col("first_collision_index"), **own))
    issues += [
        KIND.one(F.shiftrightunsigned("external_attr", 16).bitwiseAND(0xF000) == 0xA000, "symlink_entry", 7, **own),
        KIND.one(F.col("flag_bits").bitwiseAND(1) == 1, "encrypted_entry", 8, **own),
        KIND.one(file & (size > rules.max_entry_bytes), "entry_too_large", 9, actual_bytes=size, maximum_bytes=F.lit(rules.max_entry_bytes), **own),
        KIND.one(file & (size > 0) & (packed == 0), "compression_ratio_exceeded", 10, maximum_ratio=F.lit(float(rules.max_ratio)), reason=F.lit("non-empty entry has zero compressed bytes"), **own),
        KIND.one(file & (size > 0) & (ratio > float(rules.max_ratio)), "compression_ratio_exceeded", 10, actual_ratio=ratio, maximum_ratio=F.lit(float(rules.max_ratio)), **own),
    ]
    found = KIND.exploded(rows, [F.col("archive")], F.col("entry_index"), F.array(*issues))
    totals = flagged.groupBy("archive").agg(F.sum(size.cast("decimal(38,0)")).alias("total"))
    over = KIND.one(F.col("total") > rules.max_total_bytes, "archive_too_large", 11, actual_bytes=F.col("total"), maximum_bytes=F.lit(rules.max_total_bytes))
    return found.unionByName(KIND.exploded(totals, [F.col("archive")], F.lit(2**62), F.array(over)))


def zip_summary(entries: DataFrame) -> DataFrame:
    """Totals of each archive, complete whatever the report's limit."""
    size, packed, file = F.col("file_size"), F.col("compress_size"), ~F.col("is_dir")
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return entries.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if(file).alias("file_count"), F.count_if("is_dir").alias("directory_count"), exact(packed).alias("total_compressed_bytes"), exact(size).alias("total_uncompressed_bytes"),
        F.coalesce(F.max(size), F.lit(0)).alias("largest_entry_uncompressed_bytes"), F.coalesce(F.max(F.when(file & (size > 0) & (packed > 0), size / packed)), F.lit(0.0)).alias("highest_finite_compression_ratio"),
        F.count_if(file & (size > 0) & (packed == 0)).alias("unbounded_compression_ratio_entries"),
    )

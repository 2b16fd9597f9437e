"""Content inventories: building, checking, comparing, duplicates and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.config import Policy, natural
from auditframe.functions.columns import has_component, matches_any_glob, matches_glob, normal_path, sha256_digest
from auditframe.runtime import written

#: Names that an inventory leaves out by default, wherever they occur in a path.
EXCLUDED_NAMES = (".git", "__pycache__")


def manifest(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """``(path, size, sha256)`` of contents held in a table."""
    return rows.select(path.alias("path"), F.octet_length(content).cast("bigint").alias("size"), F.sha2(content.cast("binary"), 256).alias("sha256"))


def without_excluded(entries: DataFrame, patterns: Sequence[str] = (), names: Sequence[str] = EXCLUDED_NAMES) -> DataFrame:
    """Entries none of whose path components is excluded and that no glob matches, itself or by an ancestor."""
    kept = entries.filter(~has_component(F.col("path"), names))
    return kept.filter(~matches_any_glob(F.col("path"), patterns)) if patterns else kept


def in_component_order(entries: DataFrame) -> DataFrame:
    """Sorted by path components, as directory listings are: ``a/b`` before ``a-b``."""
    return entries.orderBy(F.split("path", "/"))


def component_ranks(entries: DataFrame, within: str) -> DataFrame:
    """``(within, path, place)``: each path's place in that order among those of its group, from 1."""
    return entries.select(within, "path", F.row_number().over(Window.partitionBy(within).orderBy(F.split("path", "/"))).alias("place"))


def faults(entries: DataFrame, index: str = "idx") -> DataFrame:
    """``(idx, fault)``: the first fault of each entry that has one, in the order path, form, repeat, size, digest.

    Nulls are faults of their field. Of a repeated path all but the lowest index are faulty.
    """
    by_path = Window.partitionBy("path").orderBy(index)
    checks = (
        ("invalid_path", F.col("path").isNull() | (F.col("path") == "")),
        ("not_normalized", ~normal_path(F.col("path"))),
        ("duplicate_path", F.col("nth") > 1),
        ("invalid_size", F.col("size").isNull() | (F.col("size") < 0)),
        ("invalid_digest", ~F.coalesce(sha256_digest(F.col("sha256")), F.lit(False))),
    )
    fault = F.coalesce(*[F.when(F.coalesce(wrong, F.lit(False)), code) for code, wrong in checks])
    return entries.withColumn("nth", F.row_number().over(by_path)).select(index, fault.alias("fault")).filter("fault is not null")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change, before_size, before_sha256, after_size, after_sha256)`` of every path of two valid inventories."""
    side = lambda df, name: df.select("path", F.struct("size", "sha256").alias(name))
    both = side(before, "b").join(side(after, "a"), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"), F.col("b.size").alias("before_size"), F.col("b.sha256").alias("before_sha256"), F.col("a.size").alias("after_size"), F.col("a.sha256").alias("after_sha256"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    return compared(before, after).filter("change <> 'unchanged'")


def difference_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts: added, removed, modified, unchanged."""
    kinds = ("added", "removed", "modified", "unchanged")
    return compared(before, after).agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def verified(expected: DataFrame, current: DataFrame, manifest_path: str | None = None) -> DataFrame:
    """All paths compared, without the manifest's own file unless it is listed itself."""
    if manifest_path is not None:
        listed = expected.filter(F.col("path") == manifest_path).select(F.lit(True).alias("listed")).limit(1)
        own = F.col("path") == manifest_path
        current = current.filter(~own).unionByName(current.filter(own).join(F.broadcast(listed), how="left_semi", on=F.col("listed")))
    return compared(expected, current)


def duplicate_groups(entries: DataFrame, min_size: int = 1) -> DataFrame:
    """``(sha256, size, files, reclaimable_bytes)`` of contents that occur more than once."""
    kept = entries.filter(F.col("size") >= natural("min_size", min_size))
    groups = kept.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
    return groups.select("sha256", "size", "files", (F.col("size").cast("decimal(38,0)") * (F.col("files") - 1)).cast("decimal(38,0)").alias("reclaimable_bytes"))


def duplicate_files(entries: DataFrame, min_size: int = 1) -> DataFrame:
    """The duplicate groups with a row for each of their paths: a group is never collected, however many files it has."""
    entries = kept = written(entries.filter(F.col("size") >= min_size).select("path", "size", "sha256"), "hashed")  # contents are hashed once
    return kept.join(duplicate_groups(entries, min_size), ["size", "sha256"]).select("sha256", "size", "files", "reclaimable_bytes", "path")


def duplicate_summary(entries: DataFrame, min_size: int = 1) -> DataFrame:
    """One row of counts over all entries; an empty inventory gives zeros."""
    contents = entries.groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("n"))
    eligible, repeated = F.coalesce(F.col("size") >= natural("min_size", min_size), F.lit(False)), F.col("n") > 1
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    return contents.agg(
        total(F.lit(True), F.col("n")).alias("scanned_files"), total(eligible, F.col("n")).alias("eligible_files"), F.count_if(eligible & repeated).alias("duplicate_groups"),
        total(eligible & repeated, F.col("n")).alias("duplicate_files"), total(eligible & repeated, F.col("size").cast("decimal(38,0)") * (F.col("n") - 1)).cast("decimal(38,0)").alias("reclaimable_bytes"),
    )


def policy_totals(entries: DataFrame) -> DataFrame:
    size = F.col("size").cast("decimal(38,0)")
    return entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("decimal(38,0)").alias("total_bytes"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_file_bytes"))


def policy_violations(entries: DataFrame, policy: Policy | dict) -> DataFrame:
    """``(rule_ord, rule, path, actual, maximum, patterns)``: limits, missing required paths, and forbidden paths with their patterns."""
    policy = Policy.of(policy)
    spark = entries.sparkSession
    none = {"path": F.lit(None).cast("string"), "actual": F.lit(None).cast("decimal(38,0)"), "maximum": F.lit(None).cast("bigint"), "patterns": F.lit(None).cast("array<string>")}

    def rows(df: DataFrame, order: int, rule: str, **values: Column) -> DataFrame:
        return df.select(F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule"), *[(values.get(k, v)).cast({"actual": "decimal(38,0)", "maximum": "bigint", "path": "string", "patterns": "array<string>"}[k]).alias(k) for k, v in none.items()])

    totals, parts = policy_totals(entries), []
    for order, (rule, total) in enumerate((("max_files", "files"), ("max_total_bytes", "total_bytes"), ("max_file_bytes", "largest_file_bytes"))):
        if rule in policy.limits:
            parts.append(rows(totals.filter(F.col(total) > policy.limits[rule]), order, rule, actual=F.col(total), maximum=F.lit(policy.limits[rule])))
    if policy.required_paths:
        wanted = spark.createDataFrame([(p,) for p in policy.required_paths], "path string")
        parts.append(rows(wanted.join(entries.select("path").filter(F.col("path").isin(*policy.required_paths)).distinct(), "path", "left_anti"), 3, "required_path", path=F.col("path")))
    if policy.forbidden_patterns:
        matching = F.filter(F.array(*[F.when(matches_glob(F.col("path"), p), F.lit(p)) for p in policy.forbidden_patterns]), lambda x: x.isNotNull())
        parts.append(rows(entries.select("path").distinct().withColumn("found", matching).filter("size(found) > 0"), 4, "forbidden_pattern", path=F.col("path"), patterns=F.col("found")))
    found = parts[0] if parts else rows(totals.filter(F.lit(False)), 0, "none")
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def oversize_files(entries: DataFrame, maximum: int) -> DataFrame:
    return entries.filter(F.col("size") > maximum).select("path", "size")

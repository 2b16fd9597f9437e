"""Issues of all audits: typed structs in a total order, counted whole and reported up to a limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.runtime import small, written

#: Position columns of every issue: they replace the order in which a single pass would append.
ORDER = ("pos", "rule_ord", "sub_ord")


class IssueKind:
    """Issues of one audit: ``details`` maps each possible detail to its type."""

    def __init__(self, details: Mapping[str, str]):
        self.details = dict(details)

    def one(self, when: Column, code: str, rule: int, sub: Column | int = 0, **details: Column) -> Column:
        """An issue struct where ``when`` holds, else null."""
        sub = sub if isinstance(sub, Column) else F.lit(sub)
        values = [(details[name] if name in details else F.lit(None)).cast(kind).alias(name) for name, kind in self.details.items()]
        return F.when(when, F.struct(F.lit(rule).alias("rule_ord"), sub.cast("int").alias("sub_ord"), F.lit(code).alias("code"), *values))

    def exploded(self, rows: DataFrame, keys: list[Column], pos: Column, issues: Column) -> DataFrame:
        """One row for each non-null issue of the array ``issues``."""
        found = F.explode(F.filter(issues, lambda x: x.isNotNull()))
        return rows.select(*keys, pos.cast("bigint").alias("pos"), found.alias("x")).select("*", "x.*").drop("x")


def code_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., code, n)``: complete totals."""
    return issues.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))


def reported(issues: DataFrame, max_errors: int, *keys: str) -> DataFrame:
    """The first ``max_errors`` issues of each audited thing, numbered from 1; the limit is the report's feature."""
    in_order = Window.partitionBy(*keys).orderBy(*ORDER)
    return issues.withColumn("issue_no", F.row_number().over(in_order)).filter(F.col("issue_no") <= max_errors)


def first_holders(rows: DataFrame, keys: list[str], line: str, *more: str) -> DataFrame:
    """``(keys..., first_line)`` of values that occur more than once: pre-aggregated, so a frequent value doesn't skew."""
    return rows.groupBy(*keys).agg(F.min(line).alias("first_line"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def with_first_holders(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """``rows`` with ``first_line``, null where the value (the last key) is null or occurs once.

    The repeated values are broadcast if they take few bytes; else rows without a value go round the join, so that
    they don't meet in one task, and a frequent value's rows are split by the adaptive join.
    """
    known = F.col(keys[-1]).isNotNull()
    firsts = written(first_holders(rows.filter(known), keys, line), "first-holders")
    if small(firsts):
        return rows.join(F.broadcast(firsts), keys, "left")
    return rows.filter(known).join(firsts, keys, "left").unionByName(rows.filter(~known).withColumn("first_line", F.lit(None).cast("bigint")))

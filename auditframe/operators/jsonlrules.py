"""Rules on JSON Lines of any number of files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import config
from auditframe.functions.columns import is_blank
from auditframe.functions.python import strict_json
from auditframe.operators.issues import IssueKind, with_first_holders
from auditframe.runtime import written

KIND = IssueKind({
    "line": "bigint", "actual_bytes": "bigint", "maximum_bytes": "bigint", "key": "string", "constant": "string", "column": "int",
    "fields": "array<string>", "field": "string", "first_line": "bigint", "message": "string",
})

DETAILS = {
    "blank_line": (), "line_too_large": ("actual_bytes", "maximum_bytes"), "duplicate_json_key": ("key",), "invalid_json_constant": ("constant",), "invalid_json": ("column",),
    "non_object_record": (), "missing_required_fields": ("fields",), "missing_unique_field": ("field",), "duplicate_unique_value": ("field", "first_line"),
}


@dataclass(frozen=True)
class JsonlRules:
    required: Sequence[str] = ()
    unique: str | None = None
    allow_blank_lines: bool = False
    max_line_bytes: int | None = None

    def __post_init__(self) -> None:
        config.names("required_fields", self.required)
        config.one_name("unique_field", self.unique)
        config.flag("allow_blank_lines", self.allow_blank_lines)
        config.positive_int("max_line_bytes", self.max_line_bytes, optional=True)


def checked_lines(lines: DataFrame, rules: JsonlRules) -> DataFrame:
    """``(file, line, blank, object, repeated, issues)`` of lines ``(file, line, content)``, content without its terminator.

    Every line that isn't blank is parsed once, strictly, in Arrow batches. Only uniqueness shuffles.
    A null content is a blank line.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    blank = is_blank(content)
    parsed = lines.select("file", "line", blank.alias("blank"), F.octet_length(content).alias("bytes"), strict_json(rules.unique)(F.when(~blank, content)).alias("j"))
    if rules.unique:
        parsed = with_first_holders(written(parsed.withColumn("unique_key", F.col("j.unique_key")), "json-lines"), ["file", "unique_key"], "line")
    else:
        parsed = parsed.withColumn("first_line", F.lit(None).cast("bigint"))
    line, code, keys = F.col("line"), F.coalesce(F.col("j.code"), F.lit("")), F.col("j.keys")
    record = ~F.col("blank") & (code == "")
    repeated = record & F.coalesce(F.col("first_line") < line, F.lit(False))
    issues = [KIND.one(F.col("blank") & F.lit(not rules.allow_blank_lines), "blank_line", 0, line=line)]
    if rules.max_line_bytes:
        issues.append(KIND.one(~F.col("blank") & (F.col("bytes") > rules.max_line_bytes), "line_too_large", 1, line=line, actual_bytes=F.col("bytes"), maximum_bytes=F.lit(rules.max_line_bytes)))
    issues += [
        KIND.one(code == "duplicate_json_key", "duplicate_json_key", 2, line=line, key=F.col("j.detail")),
        KIND.one(code == "invalid_json_constant", "invalid_json_constant", 2, line=line, constant=F.col("j.detail")),
        KIND.one(code == "invalid_json", "invalid_json", 2, line=line, column=F.col("j.error_column")),
        KIND.one(code == "non_object_record", "non_object_record", 2, line=line),
        KIND.one(code == "unreadable", "unreadable", 2, line=line, message=F.col("j.detail")),
    ]
    if rules.required:
        missing = F.array_except(F.array(*map(F.lit, rules.required)), keys)
        issues.append(KIND.one(record & (F.size(missing) > 0), "missing_required_fields", 3, line=line, fields=missing))
    if rules.unique:
        issues.append(KIND.one(record & ~F.array_contains(keys, F.lit(rules.unique)), "missing_unique_field", 4, line=line, field=F.lit(rules.unique)))
        issues.append(KIND.one(repeated, "duplicate_unique_value", 4, line=line, field=F.lit(rules.unique), first_line=F.col("first_line")))
    return parsed.select("file", "line", "blank", record.alias("object"), repeated.alias("repeated"), F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"))


def jsonl_issues(lines: DataFrame, rules: JsonlRules) -> DataFrame:
    return KIND.exploded(checked_lines(lines, rules), [F.col("file")], F.col("line"), F.col("issues"))


def jsonl_summary(lines: DataFrame, rules: JsonlRules) -> DataFrame:
    """Counters of each file; a line with several errors is one invalid line."""
    wrong = F.size("issues") > 0
    return checked_lines(lines, rules).groupBy("file").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if("blank").alias("blank_lines"), F.count_if("object").alias("object_records"),
        F.count_if(F.col("object") & ~wrong).alias("valid_records"), F.count_if(wrong).alias("invalid_lines"), F.count_if("repeated").alias("duplicate_records"), F.sum(F.size("issues")).alias("error_count"),
    )

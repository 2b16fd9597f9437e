"""Rules on parsed CSV rows of any number of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import config
from auditframe.functions.columns import is_type
from auditframe.operators.issues import IssueKind, with_first_holders

#: Rows as readers give them: ``error`` ends a file, or is of the one record if records were parsed alone; the header is the row with record 0.
ROW_SCHEMA = "file string, record bigint, line bigint, fields array<string>, error string"

KIND = IssueKind({
    "line": "bigint", "column": "string", "columns": "array<string>", "positions": "array<int>", "expected_fields": "int", "actual_fields": "int",
    "actual_bytes": "bigint", "maximum_bytes": "bigint", "first_line": "bigint", "expected_type": "string", "message": "string",
})

#: Details of each code, in the order of a report.
DETAILS = {
    "missing_header": (), "csv_parse_error": ("line", "message"), "empty_header_columns": ("positions",), "duplicate_header_columns": ("columns",),
    "missing_required_columns": ("columns",), "missing_rule_columns": ("columns",), "blank_row": ("line",), "row_width": ("line", "expected_fields", "actual_fields"),
    "field_too_large": ("line", "column", "actual_bytes", "maximum_bytes"), "empty_required_values": ("line", "columns"),
    "duplicate_unique_value": ("line", "column", "first_line"), "invalid_type": ("line", "column", "expected_type"),
}


@dataclass(frozen=True)
class CsvRules:
    required: Sequence[str] = ()
    not_empty: Sequence[str] = ()
    unique: str | None = None
    types: Mapping[str, str] = field(default_factory=dict)
    max_field_bytes: int | None = None

    def __post_init__(self) -> None:
        config.names("required_columns", self.required)
        config.names("not_empty_columns", self.not_empty)
        config.one_name("unique_column", self.unique)
        config.column_types(self.types)
        config.positive_int("max_field_bytes", self.max_field_bytes, optional=True)

    @property
    def named(self) -> list[str]:
        return list(dict.fromkeys([*self.not_empty, *self.types, *([self.unique] if self.unique else [])]))


def _value(column: str) -> Column:
    """The row's value of a header column, by its first position; null if the header lacks it."""
    at = F.array_position("header", F.lit(column)).cast("int")
    return F.when(at > 0, F.get("fields", at - 1))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def with_headers(rows: DataFrame) -> DataFrame:
    """Data rows beside their file's header."""
    headers = rows.filter("record = 0 and error is null and size(fields) > 0").select("file", F.col("fields").alias("header"))
    return rows.filter("record > 0 and error is null").join(headers, "file")


def header_issues(rows: DataFrame, rules: CsvRules) -> DataFrame:
    """Faults of each file's header, at position 0; a file that should be read but has no row needs a row with null fields."""
    header = F.coalesce(F.col("fields"), F.array().cast("array<string>"))
    missing = lambda names: F.array_except(_strings(names), header)
    empty = F.filter(F.transform(header, lambda v, i: F.when(v == "", i + 1)), lambda x: x.isNotNull())
    # each repeated name once, in the order of its second appearance
    again = F.array_distinct(F.filter(F.transform(header, lambda v, i: F.when(F.array_contains(F.slice(header, 1, i), v), v)), lambda x: x.isNotNull()))
    blank = F.size(header) == 0
    issues = F.array(
        KIND.one(blank, "missing_header", 0),
        KIND.one(~blank & (F.size(empty) > 0), "empty_header_columns", 1, positions=empty),
        KIND.one(~blank & (F.size(again) > 0), "duplicate_header_columns", 2, columns=again),
        KIND.one(~blank & (F.size(missing(rules.required)) > 0), "missing_required_columns", 3, columns=missing(rules.required)),
        KIND.one(~blank & (F.size(missing(rules.named)) > 0), "missing_rule_columns", 4, columns=missing(rules.named)),
    )
    return KIND.exploded(rows.filter("record = 0 and error is null"), [F.col("file")], F.lit(0), issues)


def checked_rows(rows: DataFrame, rules: CsvRules) -> DataFrame:
    """Data rows ``(file, record, line, blank, right_width, most_bytes, repeated, issues)``, all rules in one pass.

    Only uniqueness shuffles: values that occur more than once in a file, with their first line,
    are found by a pre-aggregated group-by and joined back, by broadcast if few.
    """
    data = with_headers(rows)
    right = F.size("fields") == F.size("header")
    if rules.unique:
        data = data.withColumn("unique_value", F.when(right, _value(rules.unique)))
        data = with_first_holders(data, ["file", "unique_value"], "line")
    else:
        data = data.withColumn("first_line", F.lit(None).cast("bigint"))
    blank = F.size("fields") == 0
    line = F.col("line")
    single = [
        KIND.one(blank, "blank_row", 0, line=line),
        KIND.one(~blank & ~right, "row_width", 0, line=line, expected_fields=F.size("header"), actual_fields=F.size("fields")),
    ]
    if rules.not_empty:
        empties = F.filter(F.array(*[F.when(_value(c) == "", F.lit(c)) for c in rules.not_empty]), lambda x: x.isNotNull())
        single.append(KIND.one(right & (F.size(empties) > 0), "empty_required_values", 2, line=line, columns=empties))
    repeated = right & F.coalesce(F.col("first_line") < line, F.lit(False))
    if rules.unique:
        single.append(KIND.one(repeated, "duplicate_unique_value", 3, line=line, column=F.lit(rules.unique), first_line=F.col("first_line")))
    for k, (name, kind) in enumerate(sorted(rules.types.items())):
        value = _value(name)
        single.append(KIND.one(right & (value != "") & ~is_type(value, kind), "invalid_type", 4, k, line=line, column=F.lit(name), expected_type=F.lit(kind)))
    issues = F.array(*single)
    if rules.max_field_bytes:
        big = F.transform("fields", lambda v, i: KIND.one(F.octet_length(v) > rules.max_field_bytes, "field_too_large", 1, i, line=line, column=F.get("header", i), actual_bytes=F.octet_length(v), maximum_bytes=F.lit(rules.max_field_bytes)))
        issues = F.concat(issues, F.when(right, big).otherwise(F.array()))
    most = F.when(right, F.array_max(F.transform("fields", lambda v: F.octet_length(v))))
    return data.select("file", "record", "line", blank.alias("blank"), right.alias("right_width"), most.alias("most_bytes"), repeated.alias("repeated"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def _parse_error() -> Column:
    return KIND.one(F.lit(True), "csv_parse_error", 9, line=F.col("line"), message=F.col("error"))


def csv_issues(rows: DataFrame, rules: CsvRules) -> DataFrame:
    """All issues of all files: header faults, row faults, and parse errors."""
    found = KIND.exploded(checked_rows(rows, rules), [F.col("file")], F.col("record"), F.col("issues"))
    ended = KIND.exploded(rows.filter("error is not null"), [F.col("file")], F.col("record"), F.array(_parse_error()))
    return header_issues(rows, rules).unionByName(found).unionByName(ended)


def csv_summary(rows: DataFrame, rules: CsvRules, alone: bool = False) -> DataFrame:
    """Counters of each file, all rows counted. With ``alone`` each record was parsed alone: an error is an invalid data row and ends no file."""
    valid = (F.size("issues") == 0)
    checked = checked_rows(rows, rules)
    if alone:
        no = F.lit(False)
        broken = rows.filter("record > 0 and error is not null").select("file", "record", "line", no.alias("blank"), no.alias("right_width"), F.lit(None).cast("int").alias("most_bytes"), no.alias("repeated"), F.array(_parse_error()).alias("issues"))
        checked = checked.unionByName(broken)
    return checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("data_rows"), F.count_if(valid).alias("valid_rows"), F.count_if(~valid).alias("invalid_rows"), F.count_if("blank").alias("blank_rows"),
        F.count_if("repeated").alias("duplicate_rows"), F.coalesce(F.max("most_bytes"), F.lit(0)).cast("bigint").alias("maximum_field_bytes"),
    )

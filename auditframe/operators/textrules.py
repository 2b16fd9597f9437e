"""Encoding and line hygiene of text files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import config
from auditframe.functions.columns import one_byte_chars
from auditframe.functions.python import first_bad_utf8
from auditframe.operators.issues import IssueKind

KIND = IssueKind({"count": "bigint", "byte_offset": "bigint", "styles": "array<string>", "line": "bigint", "actual_bytes": "bigint", "maximum_bytes": "bigint"})

DETAILS = {
    "utf8_bom": (), "nul_bytes": ("count",), "invalid_utf8": ("byte_offset",), "mixed_newlines": ("styles",), "bare_cr_newline": ("count",), "missing_final_newline": (),
    "trailing_whitespace": ("line",), "line_too_large": ("line", "actual_bytes", "maximum_bytes"),
}


@dataclass(frozen=True)
class TextRules:
    max_line_bytes: int | None = None
    allow_utf8_bom: bool = False
    require_final_newline: bool = True

    def __post_init__(self) -> None:
        config.positive_int("max_line_bytes", self.max_line_bytes, optional=True)
        config.flag("allow_utf8_bom", self.allow_utf8_bom)
        config.flag("require_final_newline", self.require_final_newline)


def measured(files: DataFrame) -> DataFrame:
    """``(file, content, ...)`` with byte, newline and line measures; a null content is an empty file."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    chars = F.col("chars")
    base = files.select("file", content.alias("content"), one_byte_chars(content).alias("chars"))
    crlf = F.regexp_count(chars, F.lit("\r\n"))
    counts = base.select(
        "*", F.length(chars).cast("bigint").alias("byte_count"), crlf.alias("crlf_endings"), (F.regexp_count(chars, F.lit("\n")) - crlf).alias("lf_endings"), (F.regexp_count(chars, F.lit("\r")) - crlf).alias("bare_cr_endings"),
        chars.startswith("\xef\xbb\xbf").alias("has_utf8_bom"), F.regexp_count(chars, F.lit(r"\x00")).alias("nul_bytes"), ((chars == "") | chars.endswith("\n") | chars.endswith("\r")).alias("has_final_newline"),
    )
    pieces = F.split(chars, r"\r\n|\r|\n", -1)
    lines = F.when(chars == "", F.array().cast("array<string>")).when(F.col("has_final_newline"), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    styles = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(name)) for name, c in (("lf", "lf_endings"), ("crlf", "crlf_endings"), ("cr", "bare_cr_endings"))]), lambda x: x.isNotNull())
    return counts.select("*", lines.alias("lines"), styles.alias("styles"))


def text_issues(files: DataFrame, rules: TextRules) -> DataFrame:
    """All issues of files ``(file, content)``; content that isn't UTF-8 alone goes through Python, for the offset."""
    rows = measured(files)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    rows = rows.filter(good).withColumn("bad_at", F.lit(None).cast("bigint")).unionByName(rows.filter(~good).withColumn("bad_at", first_bad_utf8("content")))
    whole = F.array(
        KIND.one(F.col("has_utf8_bom") & F.lit(not rules.allow_utf8_bom), "utf8_bom", 0),
        KIND.one(F.col("nul_bytes") > 0, "nul_bytes", 1, count=F.col("nul_bytes")),
        KIND.one(F.col("bad_at").isNotNull(), "invalid_utf8", 2, byte_offset=F.col("bad_at")),
        KIND.one(F.size("styles") > 1, "mixed_newlines", 3, styles=F.col("styles")),
        KIND.one(F.col("bare_cr_endings") > 0, "bare_cr_newline", 4, count=F.col("bare_cr_endings")),
        KIND.one(~F.col("has_final_newline") & F.lit(rules.require_final_newline), "missing_final_newline", 5),
    )

    def line_issues(line: Column, i: Column) -> Column:
        size = F.length(line).cast("bigint")
        number = (i + 1).cast("bigint")
        large = size > rules.max_line_bytes if rules.max_line_bytes else F.lit(False)
        return F.array(
            KIND.one(line.endswith(" ") | line.endswith("\t"), "trailing_whitespace", 6, 2 * i, line=number),
            KIND.one(large, "line_too_large", 6, 2 * i + 1, line=number, actual_bytes=size, maximum_bytes=F.lit(rules.max_line_bytes)),
        )

    issues = F.concat(whole, F.flatten(F.transform("lines", line_issues)))
    return KIND.exploded(rows, [F.col("file")], F.lit(0), issues)


def text_summary(files: DataFrame) -> DataFrame:
    """Byte, line and newline counters of each file; no shuffle."""
    style = F.when(F.size("styles") == 0, "none").when(F.size("styles") == 1, F.col("styles")[0]).otherwise("mixed")
    return measured(files).select(
        "file", "byte_count", F.size("lines").cast("bigint").alias("line_count"), style.alias("newline_style"), "lf_endings", "crlf_endings", "bare_cr_endings", "has_final_newline", "has_utf8_bom", "nul_bytes",
        F.size(F.filter("lines", lambda x: x.endswith(" ") | x.endswith("\t"))).alias("trailing_whitespace_lines"), F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x))), F.lit(0)).alias("maximum_line_bytes"),
    )

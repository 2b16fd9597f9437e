"""Column expressions that the audits share; all of them stay inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell glob as an anchored Java regex; ``*`` also crosses ``/``."""
    sign = lambda c: f"\\x{{{ord(c):x}}}"
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            inside = at + (pattern[at : at + 1] == "!")
            end = pattern.find("]", inside + 1)
            if end < 0:
                out.append(sign(c))
                continue
            out.append(_char_class(pattern[inside:end], inside > at, sign))
            at = end + 1
        else:
            out.append(sign(c))
    return rf"(?s)\A{''.join(out)}\z"


def _char_class(body: str, negated: bool, sign) -> str:
    parts, at = [], 0
    while at < len(body):
        if body[at + 1 : at + 2] == "-" and at + 2 < len(body):
            if body[at] <= body[at + 2]:
                parts.append(f"{sign(body[at])}-{sign(body[at + 2])}")
            at += 3
        else:
            parts.append(sign(body[at]))
            at += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a path or one of its ancestors matches a glob."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(ancestors, lambda a: a.rlike(glob_regex(pattern)))


def matches_any_glob(path: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | matches_glob(path, pattern)
    return found


def has_component(path: Column, components: Sequence[str]) -> Column:
    """Whether any component of a path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, components))) if components else F.lit(False)


def normal_path(path: Column) -> Column:
    return path.rlike(r"(?s)\A(?!/)(?!.*\\)(?!(?:.*/)?\.{1,2}(?:/|\z))(?!.*//)(?!.*/\z).+\z")


def sha256_digest(digest: Column) -> Column:
    return digest.rlike(r"\A[0-9a-f]{64}\z")


def is_blank(line: Column) -> Column:
    """No character but blanks in the Unicode sense."""
    return line.rlike(r"\A[\s\x1c-\x1f\x85\p{Z}]*\z")


_DIGITS = r"[0-9](?:_?[0-9])*"
_SPACE = r"[ \t\n\x0b\f\r]*"
_NUMBER = rf"\A{_SPACE}[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?{_SPACE}\z"


def is_type(value: Column, kind: str) -> Column:
    """Whether a string is of a declared type: integer, number (finite), boolean or date (YYYY-MM-DD)."""
    if kind == "integer":
        return value.rlike(r"\A[+-]?[0-9]+\z")
    if kind == "boolean":
        return value.isin("true", "false")
    if kind == "date":
        shaped = value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.substring(value, 1, 4) != "0000")
        return F.coalesce(shaped & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))
    digits, blanks = unicode_digits()
    plain = F.when(is_ascii(value), value).otherwise(F.translate(value, digits + blanks, "0123456789" * (len(digits) // 10) + " " * len(blanks)))
    return F.coalesce(plain.rlike(_NUMBER) & (F.abs(F.regexp_replace(plain, r"[_\s]", "").try_cast("double")) < float("inf")), F.lit(False))


def is_ascii(value: Column) -> Column:
    return value.rlike(r"\A[\x00-\x7f]*\z")


@cache
def unicode_digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, in runs from 0 to 9, and all blanks, as numbers may have them outside ASCII texts."""
    signs = [chr(c) for c in range(128, 0x20000)]
    zeros = [ord(c) for c in signs if unicodedata.decimal(c, None) == 0]
    runs = "".join(chr(zero + i) for zero in zeros for i in range(10))
    return runs, "".join(chr(c) for c in range(128, 0x3001) if chr(c).isspace())


def one_byte_chars(content: Column) -> Column:
    """Bytes as characters, one each, so that string functions count bytes."""
    return F.decode(content, "ISO-8859-1")


"""Rows that fail to parse: typed rows beside every rejected record and its reasons."""

from __future__ import annotations

import csv
import math
import re
import sys
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The export's fields in order; those that are judged have a constructor below.
EVENT_FIELDS = ("id", "occurred_on", "event", "duration_ms", "success")

_RECORD = "struct<id:string,occurred_on:date,event:string,duration_ms:double,success:boolean>"
_NUMBER = re.compile(r"[ \t\r\n\f\v]*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\r\n\f\v]*")
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def day(value: str) -> date | None:
    """A calendar date written YYYY-MM-DD; empty is no value."""
    if not value:
        return None
    if not _DAY.fullmatch(value):
        raise ValueError("not a date")
    return date.fromisoformat(value)


def finite(value: str) -> float | None:
    """A finite decimal number with optional sign, fraction, exponent and blanks around it."""
    if not value:
        return None
    if not _NUMBER.fullmatch(value) or not math.isfinite(number := float(value)):
        raise ValueError("not a finite number")
    return number


def truth(value: str) -> bool | None:
    if value not in ("", "true", "false"):
        raise ValueError("not true or false")
    return value == "true" if value else None


CONSTRUCTORS = {"occurred_on": day, "duration_ms": finite, "success": truth}


def without_ending(record: str) -> str:
    """The record without one line ending."""
    if record.endswith("\r\n"):
        return record[:-2]
    return record[:-1] if record.endswith(("\n", "\r")) else record


def scan_fields(record: str) -> list[str] | None:
    """Fields of one record by the quoting rules alone, line breaks being ordinary characters; None: bad quoting."""
    fields, at = [], 0
    while True:
        if record.startswith('"', at):
            parts, at = [], at + 1
            while True:
                end = record.find('"', at)
                if end < 0:
                    return None
                parts.append(record[at:end])
                at = end + 1
                if not record.startswith('"', at):
                    break
                parts.append('"')
                at += 1
            fields.append("".join(parts))
            if at < len(record) and record[at] != ",":
                return None
        else:
            end = record.find(",", at)
            end = len(record) if end < 0 else end
            fields.append(record[at:end])
            at = end
        if at >= len(record):
            return fields
        at += 1


def read_fields(record: str) -> list[str]:
    """Fields by the strict csv reader; its structural exceptions are ValueErrors named by their reason.

    The reader ends a record at a line break outside quotes; such records, and those it
    refuses, are settled by the quoting rules.
    """
    try:
        rows = list(csv.reader([record], strict=True))
        if len(rows) == 1 and not record.endswith(("\r", "\n")):
            return rows[0]
        if not record:
            return []
    except csv.Error:
        pass
    fields = scan_fields(record)
    if fields is None:
        raise ValueError("quoting")
    return fields


def judge(raw: str | None) -> tuple[dict | None, list[str]]:
    """The typed event of one record, or the reasons against it."""
    try:
        fields = read_fields(without_ending(raw or ""))
    except ValueError as error:
        return None, [str(error)]
    if len(fields) != len(EVENT_FIELDS):
        return None, ["width"]
    event, reasons = {}, []
    for name, value in zip(EVENT_FIELDS, fields):
        try:
            event[name] = CONSTRUCTORS.get(name, str)(value)
        except ValueError:
            reasons.append(name)
    return (None if reasons else event), reasons


def parse_events(records: DataFrame, key: str = "line_id", text: str = "raw_line") -> DataFrame:
    """One row ``(key, record, reasons)`` for each input row; ``record`` is null where ``reasons`` is not empty.

    Each record is judged alone, without one line ending. Nothing is shuffled. A null or empty
    record has the reason ``width``. Repeated rows come out repeated, an empty table
    gives an empty one, and other columns, whatever their names, are not read.
    """
    picked = records.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {picked.schema['key'].dataType.simpleString()}, record {_RECORD}, reasons array<string>"
    event = pa.struct([("id", pa.string()), ("occurred_on", pa.date32()), ("event", pa.string()), ("duration_ms", pa.float64()), ("success", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the limit is the whole process's, which other readers use too
            usual = csv.field_size_limit(sys.maxsize)
            try:
                judged = [judge(x) for x in batch.column(1).to_pylist()]
            finally:
                csv.field_size_limit(usual)
            columns = [batch.column(0), pa.array([e for e, _ in judged], event), pa.array([r for _, r in judged], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "record", "reasons"])

    return picked.mapInArrow(parse, schema).withColumnRenamed("key", key)


def accepted(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """The readable records as typed event rows."""
    return parsed.filter("record is not null").select(F.col(key).alias("source_key"), "record.*")


def rejected(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """``(key, reason)``, a row for each reason."""
    return parsed.select(key, F.explode("reasons").alias("reason"))

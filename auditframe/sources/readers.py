"""Data sources for directory trees, CSV, ZIP and SQLite files: listed on the driver, read on the executors."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import sqlite3
import stat
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditframe.config import patterns as checked_patterns
from auditframe.operators.catalogrules import CATALOG_SCHEMA
from auditframe.operators.csvrules import ROW_SCHEMA
from auditframe.operators.manifest import EXCLUDED_NAMES
from auditframe.operators.ziprules import ENTRY_SCHEMA

#: Bytes of files that one task reads together.
TASK_BYTES = 256 * 1024 * 1024


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


def grouped(files: list[tuple[str, int]]) -> list[Files]:
    """Files in the order given, in groups of about ``TASK_BYTES``."""
    groups, size = [[]], 0
    for path, n in files:
        if groups[-1] and size + n > TASK_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += n
    return [Files(g) for g in groups]


def _matches(relative: str, patterns: list[str]) -> bool:
    from fnmatch import fnmatchcase

    parts = relative.split("/")
    return any(fnmatchcase("/".join(parts[:n]), p) for n in range(1, len(parts) + 1) for p in patterns)


def listed(root: str, names: list[str], patterns: list[str]) -> list[tuple[str, int]]:
    """Relative paths and sizes of the regular files below a root, hidden ones too; excluded directories aren't entered."""
    found = []
    for folder, dirs, files in os.walk(root):
        inside = os.path.relpath(folder, root).replace(os.sep, "/")
        relative = lambda name: name if inside == "." else f"{inside}/{name}"  # noqa: B023, E731
        dirs[:] = [d for d in dirs if d not in names and not _matches(relative(d), patterns)]
        for name in files:
            path = os.path.join(folder, name)
            if name not in names and not _matches(relative(name), patterns) and stat.S_ISREG(os.stat(path).st_mode if os.path.exists(path) else 0):
                found.append((relative(name), os.path.getsize(path)))
    return sorted(found, key=lambda f: f[0].split("/"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def files(self) -> list[tuple[str, int]]:
        return [(p, os.path.getsize(p) if os.path.isfile(p) else 0) for p in json.loads(self.options["paths"])]

    def partitions(self) -> list[Files]:
        return grouped(self.files())

    def rows(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)


class _TreeReader(_Reader):
    def files(self) -> list[tuple[str, int]]:
        return listed(self.options["root"], json.loads(self.options["names"]), json.loads(self.options["patterns"]))

    def rows(self, path: str) -> Iterator[tuple]:
        digest, full = hashlib.sha256(), os.path.join(self.options["root"], path)
        with open(full, "rb") as handle:
            while chunk := handle.read(1 << 20):
                digest.update(chunk)
        yield path, os.path.getsize(full), digest.hexdigest()


class _ContentReader(_Reader):
    """Whole files up to a cap; of a larger one, ``too_large`` and no content."""

    def rows(self, path: str) -> Iterator[tuple]:
        most = int(self.options["maxbytes"])
        with open(path, "rb") as handle:
            content = handle.read(most + 1)
        yield (path, None, True) if len(content) > most else (path, content, False)


class _CsvReader(_Reader):
    """Strict rows: quote state runs through a file, so a file is one task's; a structural fault is its last row."""

    def rows(self, path: str) -> Iterator[tuple]:
        with open(path, newline="", encoding="utf-8-sig") as handle:
            yield from csv_rows(path, handle)


def csv_rows(name: str, lines) -> Iterator[tuple]:
    """(file, record, line, fields, error) of physical lines; an empty file has a header row without fields."""
    reader, record = csv.reader(lines, strict=True), 0
    try:
        for fields in reader:
            yield name, record, reader.line_num, fields, None
            record += 1
        if not record:
            yield name, 0, 0, [], None
    except (csv.Error, TypeError) as error:
        yield name, record, reader.line_num or 1, None, str(error)


class _ZipReader(_Reader):
    """Central directories only: nothing is decompressed."""

    def rows(self, path: str) -> Iterator[tuple]:
        with zipfile.ZipFile(path) as archive:
            for index, entry in enumerate(archive.infolist(), 1):
                yield path, index, entry.orig_filename, entry.is_dir(), entry.compress_size, entry.file_size, entry.external_attr, entry.flag_bits


class _SqliteReader(_Reader):
    """Catalog and health of databases, read-only; no application row is selected."""

    def rows(self, path: str) -> Iterator[tuple]:
        empty = dict.fromkeys(("ord", "type", "name", "tbl_name", "hidden", "not_null", "pk", "text_value", "int_value"))

        def row(kind: str, **values) -> tuple:
            return (path, kind, *(empty | values).values())

        connection = sqlite3.connect(f"{Path(path).resolve(strict=True).as_uri()}?mode=ro", uri=True, timeout=5.0)
        try:
            if hasattr(connection, "enable_load_extension"):  # else this build can't load any
                connection.enable_load_extension(False)
            connection.execute("PRAGMA query_only = ON")
            connection.execute("PRAGMA trusted_schema = OFF")
            for i, (message,) in enumerate(connection.execute(f"PRAGMA quick_check({int(self.options['maxerrors']) + 1})")):
                yield row("quick_check", ord=i, text_value=str(message))
            objects = connection.execute("SELECT type, name, tbl_name FROM sqlite_schema WHERE name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall()
            for i, (kind, name, table) in enumerate(objects):
                yield row("object", ord=i, type=str(kind), name=str(name), tbl_name=str(table))
            for name in (str(name) for kind, name, _ in objects if kind == "table"):
                for c in connection.execute('SELECT cid, name, "notnull", pk, hidden FROM pragma_table_xinfo(?)', (name,)):
                    yield row("column", ord=c[0], name=c[1], tbl_name=name, not_null=c[2], pk=c[3], hidden=c[4])
                for kind in ("foreign_key", "index"):
                    for (i,) in connection.execute(f"SELECT {'id' if kind == 'foreign_key' else 'seq'} FROM pragma_{kind}_list(?)", (name,)):
                        yield row(kind, ord=i, tbl_name=name)
            for i, (table, row_id, parent, constraint) in enumerate(connection.execute("PRAGMA foreign_key_check")):
                yield row("violation", ord=i, name=str(parent), tbl_name=str(table), int_value=row_id, pk=constraint)
            for name in ("page_count", "freelist_count", "page_size", "user_version", "application_id", "encoding"):
                (value,) = connection.execute(f"PRAGMA {name}").fetchone()
                yield row("pragma", name=name, **({"text_value": value} if name == "encoding" else {"int_value": int(value)}))
            yield row("pragma", name="file_size", int_value=os.path.getsize(path))
        finally:
            connection.close()


def _source(title: str, columns: str, kind: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return kind(self.options)

    return Source


_SOURCES = {
    "audit_tree": ("path string, size bigint, sha256 string", _TreeReader),
    "audit_content": ("file string, content binary, too_large boolean", _ContentReader),
    "audit_csv": (ROW_SCHEMA, _CsvReader),
    "audit_zip": (ENTRY_SCHEMA, _ZipReader),
    "audit_sqlite": (CATALOG_SCHEMA, _SqliteReader),
}


def _read(spark: SparkSession, title: str, **options: str) -> DataFrame:
    spark.dataSource.register(_source(title, *_SOURCES[title]))
    return spark.read.format(title).options(**options).load()


def tree(spark: SparkSession, root: str, patterns=(), names=EXCLUDED_NAMES) -> DataFrame:
    """``(path, size, sha256)`` of the files below ``root``; excluded ones are never read. A missing root has no files."""
    return _read(spark, "audit_tree", root=os.path.realpath(root), names=json.dumps(list(names)), patterns=json.dumps(list(checked_patterns(patterns))))


def contents(spark: SparkSession, paths, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    return _read(spark, "audit_content", paths=json.dumps([str(p) for p in paths]), maxbytes=str(max_bytes))


def csv_files(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, "audit_csv", paths=json.dumps([str(p) for p in paths]))


def zip_entries(spark: SparkSession, paths) -> DataFrame:
    return _read(spark, "audit_zip", paths=json.dumps([str(p) for p in paths]))


def sqlite_catalogs(spark: SparkSession, paths, max_errors: int = 100) -> DataFrame:
    return _read(spark, "audit_sqlite", paths=json.dumps([str(p) for p in paths]), maxerrors=str(max_errors))

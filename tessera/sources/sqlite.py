"""A read-only SQLite table as a Spark data source, read in ranges of rowid.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("table", name).load()

The file must be reachable under one path from all executors."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

TYPES = (("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))


def _connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _connect(self.options["path"])
        try:
            columns = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda declared: next((t for k, t in TYPES if k in declared.upper()), StringType())
        return StructType([StructField(c[1], kind(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[Range]:
        con = _connect(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        finally:
            con.close()
        return [] if low is None else [Range(a, min(high + 1, a + self.rows)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: Range) -> Iterator[tuple]:
        con = _connect(self.path)
        try:
            casts = [str if isinstance(f.dataType, StringType) else bytes if isinstance(f.dataType, BinaryType) else float if isinstance(f.dataType, DoubleType) else int for f in self.schema]
            columns = ", ".join(_name(f.name) for f in self.schema)
            for row in con.execute(f"SELECT {columns} FROM {_name(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))
        finally:
            con.close()

"""Data source ``sqlite``: one table of many SQLite files, opened read-only."""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType


class _Store(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _columns(path: str, table: str) -> list[tuple[str, bool]]:
    """(name, whether declared an integer) of a table's columns."""
    with _open(path) as db:
        return [(name, "INT" in (kind or "").upper()) for _, name, kind, *_ in db.execute(f'PRAGMA table_info("{table}")')]


class _Reader(DataSourceReader):
    """One partition a file. A file without the table, or damaged, gives one row with only store_path and store_error."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.pattern, self.table, self.columns = options["path"], options["dbtable"].replace('"', ""), schema.fields[2:]

    def partitions(self) -> list[InputPartition]:
        return [_Store(p) for p in sorted(glob.glob(self.pattern, recursive=True))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with _open(partition.path) as db:
                there = {name for _, name, *_ in db.execute(f'PRAGMA table_info("{self.table}")')}
                names = ", ".join(f'"{f.name}"' if f.name in there else "NULL" for f in self.columns)
                for row in db.execute(f'SELECT {names} FROM "{self.table}"'):
                    yield (partition.path, None, *(self._value(v, f) for v, f in zip(row, self.columns, strict=True)))
        except sqlite3.Error as error:
            yield (partition.path, str(error), *([None] * len(self.columns)))

    @staticmethod
    def _value(value: object, field: StructField) -> object:
        if value is None or isinstance(field.dataType, LongType):
            return value if isinstance(value, int) else None
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


class Sqlite(DataSource):
    """Options ``path`` (glob of files) and ``dbtable``. Columns come from the first file that has the table: integers
    as bigint, all others as text; a value of another kind than its column is NULL."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        for path in sorted(glob.glob(self.options["path"], recursive=True)):
            try:
                found = _columns(path, self.options["dbtable"].replace('"', ""))
            except sqlite3.Error:
                continue
            if found:
                fields = [StructField(n, LongType() if whole else StringType()) for n, whole in found]
                return StructType([StructField("store_path", StringType()), StructField("store_error", StringType()), *fields])
        return StructType([StructField("store_path", StringType()), StructField("store_error", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Sqlite)

"""Data source ``numbered_lines``: text files with their line numbers, plain or compressed with zstd."""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    """One partition a file; a file is streamed, so its size is no limit. A file that cannot be read gives one row with
    line_no 0 and the error, so that it is counted and not lost."""

    def __init__(self, options: dict) -> None:
        self.pattern = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.pattern, recursive=True)) if os.path.isfile(p)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path
        try:
            with open(path, "rb") as raw:
                stream = raw
                if path.endswith(".zst"):
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                for number, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n"), 1):
                    yield path, number, line.rstrip("\r\n"), None
        except Exception as error:  # an unreadable file must not end the scan
            yield path, 0, None, str(error)


class NumberedLines(DataSource):
    """Option ``path``: a glob, with ``**`` for any number of folders."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file_path string, line_no bigint, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(NumberedLines)

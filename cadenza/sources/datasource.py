"""Python data sources: byte ranges of files as rows, and a sink that writes chunks at byte positions.

`byteranges` reads nothing but the bytes asked for: a partition is one range of at most `chunk` bytes, opened
with Arrow's file systems (local, HDFS, object stores). `bytefile` writes rows (position, data) into one file of
a file system that can write in place; it truncates first unless `keepExistingData` is true.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import InputError, EngineError

CHUNK = 8 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.start, self.stop, self.chunk = int(options.get("start", 0)), options.get("end"), int(options.get("chunk", CHUNK))
        if not self.paths or self.start < 0 or self.chunk < 1:
            raise InputError.bad("byteranges needs a path, start >= 0 and chunk >= 1")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            fs, p = _open(path)
            size = fs.get_file_info(p).size
            if size is None:
                raise InputError.bad(f"no file {path}")
            end = size if self.stop is None else min(size, int(self.stop))
            out += [_Range(path, a, min(end, a + self.chunk)) for a in range(self.start, end, self.chunk)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        fs, p = _open(part.path)
        with fs.open_input_file(p) as f:
            yield part.path, part.start, f.read_at(part.end - part.start, part.start)


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return "uri string, position bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return ByteRangeReader(dict(self.options))


class _Written(WriterCommitMessage):
    def __init__(self, end: int) -> None:
        self.end = end


class ByteFileWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "").removeprefix("file://")
        self.base, self.keep = int(options.get("position", 0)), str(options.get("keepExistingData", options.get("keepexistingdata", "false"))).lower() == "true"
        if not self.path or self.base < 0:
            raise InputError.bad("bytefile needs a path and a position of 0 or more")
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        with open(self.path, "ab") as f:
            if not self.keep:
                f.truncate(0)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        end = 0
        handle = os.open(self.path, os.O_WRONLY | os.O_CREAT)
        try:
            for row in rows:
                at = self.base + row.position
                if os.pwrite(handle, bytes(row.data), at) != len(row.data):
                    raise EngineError("mux-error", f"short write to {self.path}")
                end = max(end, at + len(row.data))
        finally:
            os.close(handle)
        return _Written(end)

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        if not self.keep:
            Path(self.path).unlink(missing_ok=True)


class ByteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytefile"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ByteFileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    from ..session import prepare

    prepare(spark)
    spark.dataSource.register(ByteRanges)
    spark.dataSource.register(ByteFile)

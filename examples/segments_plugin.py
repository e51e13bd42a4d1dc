"""A data source of one's own: a folder of segments, files whose lines are an id, a tab and data.

As a table, each range of ``bytesPerPartition`` bytes (64 MB by default) of a segment is a partition;
a line belongs to the range it starts in. As a stream, segments count in the order of their names: new
ones must have greater names, and a micro-batch is all segments that came since the last one. Empty
lines are no rows; a line without a tab has null data; an id that is no number is null.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ROWS = 10_000


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Folder:
    """The segments of a folder on any storage that Arrow opens."""

    def __init__(self, options: dict, schema: StructType):
        self.uri = options["path"]
        self.size = int(options.get("bytesPerPartition", 64 << 20))
        self.names = schema.fieldNames()

    def segments(self) -> list[fs.FileInfo]:
        store, path = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(path))
        return sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)

    def ranges(self, segments: list[fs.FileInfo]) -> list[Range]:
        return [Range(f.path, at, min(at + self.size, f.size)) for f in segments for at in range(0, f.size, self.size)]

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        ids, data = [], []
        with store.open_input_file(part.path) as file, io.BufferedReader(file, 1 << 20) as lines:
            at = part.start
            if at:  # the line that the range begins within belongs to the one before
                lines.seek(at - 1)
                at += len(lines.readline()) - 1
            while at < part.end and (line := lines.readline()):
                at += len(line)
                key, tab, rest = line.rstrip(b"\r\n").decode().partition("\t")
                if not (key or tab):
                    continue
                ids.append(int(key) if key.removeprefix("-").isdecimal() else None)
                data.append(rest if tab else None)
                if len(ids) == ROWS:
                    yield self.batch(ids, data)
                    ids, data = [], []
        if ids:
            yield self.batch(ids, data)

    def batch(self, ids: list, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.string())], names=self.names)


class TableReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return self.folder.ranges(self.folder.segments()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition) if partition.path else iter(())


class StreamReader(DataSourceStreamReader):
    """An offset is the name of the last segment that was read."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"segment": ""}

    def latestOffset(self) -> dict:
        return {"segment": max((f.base_name for f in self.folder.segments()), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.ranges([f for f in self.folder.segments() if start["segment"] < f.base_name <= end["segment"]])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return "request_id bigint, data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(Folder(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(Folder(self.options, schema))

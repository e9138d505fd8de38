"""Growing line files as a stream: complete lines with their byte offsets.

Spark's file source reads a file once; sessions are appended to.  This source keeps
(inode, offset, modification time) of each file, goes on from there while the file is
the same and hasn't shrunk, and starts anew otherwise.  A line without its end stays
for the next batch.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_path string, source_offset long, raw_json string"
#: Bytes of one file that one task reads at most; what is beyond follows in further tasks of the batch.
SPAN = 64 << 20


class Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


def last_line_end(path: str, begin: int, size: int, step: int = 1 << 16) -> int:
    """Offset after the last line end in path[begin:size]; begin if there is none."""
    with open(path, "rb") as file:
        at = size
        while at > begin:
            low = max(begin, at - step)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return begin


def read_span(path: str, begin: int, end: int) -> Iterator[tuple[str, int, str]]:
    """Lines that start in path[begin:end]; a line that a former span began isn't among them."""
    with open(path, "rb") as file:
        at = begin
        if begin:
            file.seek(begin - 1)
            at = begin - 1 + len(file.readline())
        file.seek(at)
        while at < end and (line := file.readline()):
            text = line.decode("utf-8", "replace").strip()
            if text:
                yield path, at, text
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files = {}
        for path in sorted(glob.glob(self.pattern)):
            stat = os.stat(path)
            files[path] = [stat.st_ino, last_line_end(path, 0, stat.st_size), stat.st_mtime]
        return {"files": json.dumps(files)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        spans = []
        for path, (inode, until, _) in after.items():
            old = before.get(path)
            begin = old[1] if old and old[0] == inode and old[1] <= until else 0
            spans += [Span(path, low, min(low + SPAN, until)) for low in range(begin, until, SPAN)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition.path, partition.begin, partition.end)

    def commit(self, end: dict) -> None:
        """Nothing: the checkpoint holds the offsets."""


class TailSource(DataSource):
    """spark.dataSource.register(TailSource); spark.readStream.format("tail_lines").load("/logs/*.jsonl")"""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> TailReader:
        return TailReader(self.options)

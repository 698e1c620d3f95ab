"""A streaming source of lines that are appended to files.

Spark's own file stream takes a file once; lines added later are never seen. This one keeps a byte offset per file, so each batch holds
what was added since the last one, whole lines only. A file that became shorter was rotated and starts anew.

Options: path (a folder, local or of a file system that pyarrow opens), pattern (of file names, *.log by default), start (beginning
or end: only what comes after the query's first start). Columns: file, offset (of the line's first byte), value.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.named_files import file_system

#: Bytes that one task reads, and bytes that are looked at together for a line's end.
PART_BYTES, LOOK_BYTES = 64 << 20, 1 << 16


@dataclass
class Part(InputPartition):
    """Bytes of a file; lines that begin there are in it."""

    file: str
    start: int
    end: int
    first: bool

    def __init__(self, file: str, start: int, end: int, first: bool):
        self.file, self.start, self.end, self.first = file, start, end, first


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, start: str):
        self.path, self.pattern, self.start = path, pattern, start

    def _sizes(self) -> dict[str, int]:
        """Bytes up to the last whole line of each file."""
        from pyarrow import fs

        system, root = file_system(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                end = info.size
                with system.open_input_file(info.path) as f:
                    while end:
                        at = max(0, end - LOOK_BYTES)
                        cut = f.read_at(end - at, at).rfind(b"\n")
                        end = at + cut + 1 if cut >= 0 else at
                        if cut >= 0:
                            break
                found[info.base_name] = end
        return found

    def initialOffset(self) -> dict:
        return {"files": json.dumps(self._sizes() if self.start == "end" else {})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, after, parts = json.loads(start["files"]), json.loads(end["files"]), []
        for file, size in sorted(after.items()):
            at = before.get(file, 0)
            at = 0 if at > size else at
            parts += [Part(file, a, min(size, a + PART_BYTES), a == at) for a in range(at, size, PART_BYTES)]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        system, root = file_system(self.path)
        with system.open_input_file(posixpath.join(root, partition.file)) as f:
            pos = at = partition.start if partition.first else partition.start - 1  # a line that began before belongs to the part before
            held, skip = b"", not partition.first
            while at < partition.end and (block := f.read_at(LOOK_BYTES, pos)):
                pos += len(block)
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if not skip and at < partition.end:
                        yield partition.file, at, line.rstrip(b"\r").decode("utf-8", "replace")
                    at, skip = at + len(line) + 1, False

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Format log_tail."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*.log"), self.options.get("start", "beginning"))


def tail(spark, path: str, pattern: str = "*.log", start: str = "beginning"):
    """file, offset, value: a stream of the lines of a folder's files, those appended later included."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("pattern", pattern).option("start", start).load()

"""A sink that puts one file of a given name down per row.

A task writes its rows below a staging folder of its own. Only when all of them are there it moves them to their names, and notes these in
a list beside the staged files; if that fails it takes back what it has moved. When the job ends well the staging folder goes; if it fails,
the lists say which files it made, and these go, too. A file that exists stays as it is, unless `replace` is set. Of rows of one
name, one stays.

Options: path (local, or of a file system that pyarrow opens), replace (true or false). Columns: file (a relative path), content.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_system(path: str):
    """The file system of a path, and the path in there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def there(system, path: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its files, and how many there are."""

    listing: str
    files: int


class NamedFileWriter(DataSourceWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.staging = path, replace, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        own = posixpath.join(root, self.staging, uuid.uuid4().hex)
        system.create_dir(own, recursive=True)
        names: list[str] = []
        for row in rows:
            name = posixpath.normpath(row["file"])
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"not a file below the folder: {row['file']}")
            with system.open_output_stream(posixpath.join(own, str(len(names)))) as f:
                f.write((row["content"] or "").encode("utf-8", "surrogatepass"))
            names.append(name)
        moved: list[str] = []
        try:
            for i, name in enumerate(names):
                target = posixpath.join(root, name)
                if there(system, target) and not self.replace:
                    continue
                system.create_dir(posixpath.dirname(target), recursive=True)
                system.move(posixpath.join(own, str(i)), target)
                moved.append(name)
            listing = posixpath.join(own, "moved")
            with system.open_output_stream(listing) as f:
                f.write("\n".join(moved).encode("utf-8", "surrogatepass"))
        except Exception:
            for name in moved:
                system.delete_file(posixpath.join(root, name))
            raise
        return Written(listing, len(moved))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Takes back the files of tasks that ended well in a job that did not."""
        system, root = file_system(self.path)
        for m in messages:
            if m is not None:
                with system.open_input_stream(m.listing) as f:
                    for name in filter(None, f.read().decode("utf-8", "surrogatepass").split("\n")):
                        system.delete_file(posixpath.join(root, name))
        self._clear()

    def _clear(self) -> None:
        system, root = file_system(self.path)
        folder = posixpath.join(root, self.staging)
        if there(system, folder):
            system.delete_dir(folder)


class NamedFiles(DataSource):
    """Format named_files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"], self.options.get("replace", "false") == "true")

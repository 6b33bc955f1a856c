"""A data source that writes and reads GEDCOM files: ``spark.dataSource.register(GedcomSource)``, then format("gedcom")."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LINES = "file string, record long, level int, tag string, xref string, value string"


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, s3, gs, hdfs) and the path there."""
    if not urlsplit(path).scheme:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str  # under the folder for unfinished files
    lines: int


class GedcomWriter(DataSourceWriter):
    """Each task writes a file of its own name to a folder for unfinished ones; the commit moves those of the tasks that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def folder(self, base: str) -> str:
        return posixpath.join(base, f"_unfinished-{self.job}")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = at(self.path)
        fs.create_dir(self.folder(base), recursive=True)
        name, lines = f"{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with fs.open_output_stream(posixpath.join(self.folder(base), name)) as out:
            for row in rows:
                out.write(f"{row[0]}\n".encode())
                lines += 1
        return Written(context.partitionId(), name, lines)

    def commit(self, messages: list) -> None:
        fs, base = at(self.path)
        if self.overwrite:
            self.clear(fs, base)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            if m.lines:
                fs.move(posixpath.join(self.folder(base), m.name), posixpath.join(base, f"part-{m.part:05d}-{self.job[:8]}.ged"))
        fs.delete_dir(self.folder(base))
        with fs.open_output_stream(posixpath.join(base, "_SUCCESS")):
            pass

    def clear(self, fs: pafs.FileSystem, base: str) -> None:
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.type == pafs.FileType.File:
                fs.delete_file(f.path)

    def abort(self, messages: list) -> None:
        fs, base = at(self.path)
        if fs.get_file_info(self.folder(base)).type != pafs.FileType.NotFound:
            fs.delete_dir(self.folder(base))


@dataclass
class File(InputPartition):
    path: str


class GedcomReader(DataSourceReader):
    """The lines of the files under a path, a file to a partition, taken apart; ``record`` counts a file's records from 0."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        fs, base = at(self.path)
        found = fs.get_file_info(base)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base))
        return [File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.endswith(".ged")]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        fs, _ = at(self.path)
        record = -1
        with fs.open_input_stream(partition.path) as raw:
            import io

            for line in io.TextIOWrapper(raw, encoding="utf-8", newline="\n"):
                level, _, rest = line.rstrip("\n").partition(" ")
                record += level == "0"
                xref = None
                if rest.startswith("@") and level == "0":
                    xref, _, rest = rest.partition(" ")
                tag, _, value = rest.partition(" ")
                yield partition.path, record, int(level), tag, xref, value or None


class GedcomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gedcom"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> GedcomReader:
        return GedcomReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> GedcomWriter:
        if len(schema) != 1:
            raise ValueError("gedcom: one column, the line")
        return GedcomWriter(self.options["path"], overwrite)

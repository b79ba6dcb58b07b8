"""Crystal files as a data source: spark.read.format("cif").load(path) and df.write.format("cif").save(path).

Reading lists the files of a folder on the driver and deals them out, FILES to a task; the option names (patterns, parted
by commas) leaves out files by their name before any is opened. Conditions are not pushed down: in Spark 4.1.2 a source in
Python that takes them keeps them for later reads of the same DataFrame, which then lack rows. Writing takes place in two phases: a task writes its files to a folder of its own below _drafts, and when all tasks
have ended each of these folders is renamed into place; if one fails, all drafts are deleted and the target is as before.
Folders are reached by pyarrow's file systems, so local, HDFS and object stores will do. Columns are those of cif.SCHEMA.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import cif

#: Files that a task reads.
FILES = 500
#: Data blocks of a packed file.
BLOCKS = 5000
#: Rows of a batch that is read.
ROWS = 1000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}")


def _files(path: str) -> list[str]:
    """Crystal files below a path, those of unfinished writes left out, by name."""
    store, top = _place(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".cif", ".cifs")) and "/_drafts/" not in f.path)


def _stem(file: str) -> str:
    return file.rsplit("/", 1)[-1].removesuffix(".cif")


@dataclass
class _Files(InputPartition):
    files: list[str]


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class CifReader(DataSourceReader):
    def __init__(self, path: str, names: str, schema: StructType):
        self.path, self.names, self.schema = path, [n.strip() for n in names.split(",")], schema

    def _wanted(self, stem: str) -> bool:
        return any(fnmatchcase(stem, n) for n in self.names)

    def _may_hold(self, file: str) -> bool:
        """Whether a packed file may have blocks of a wanted name, by the first character of its blocks."""
        first = unquote(file.rsplit("/", 1)[-1].removesuffix(".cifs").split("-", 1)[-1])
        return any(n[:1] == first or n[:1] in ("*", "?", "[") for n in self.names)

    def partitions(self):
        found = _files(self.path)
        files = [f for f in found if f.endswith(".cif") and self._wanted(_stem(f))]
        packed = [_Files([f]) for f in found if f.endswith(".cifs") and self._may_hold(f)]
        return [_Files(files[k : k + FILES]) for k in range(0, len(files), FILES)] + packed or [_Files([])]

    def _texts(self, files: list[str]) -> Iterator[tuple[str, str]]:
        """Name and text of every wanted crystal."""
        store, _ = _place(self.path)
        for file in files:
            with store.open_input_stream(file) as stream:
                text = stream.read().decode()
            if file.endswith(".cif"):
                yield _stem(file), text
                continue
            blocks = re.split(r"^data_(.*)\n", text, flags=re.M)[1:]
            yield from ((name, block) for name, block in zip(blocks[::2], blocks[1::2]) if self._wanted(name))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        schema, rows = to_arrow_schema(self.schema), []
        for name, text in self._texts(partition.files):
            row = {"structure_id": name, **cif.parse(text)}
            row["atoms"] = [dict(zip(("element", "x", "y", "z", "occupancy"), a)) for a in row["atoms"]]
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class CifWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, packed: bool = False):
        self.path, self.overwrite, self.packed, self.job = path, overwrite, packed, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        store, top = _place(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId()}-{self.job}"
        folder = f"{top}/_drafts/{self.job}/{context.taskAttemptId()}/{name}"
        store.create_dir(folder, recursive=True)
        held: dict[str, list[str]] = {}
        number = 0

        def flush(first):
            nonlocal number
            with store.open_output_stream(f"{folder}/{number:06d}-{quote(first, safe='')}.cifs") as stream:
                stream.write("\n".join(held.pop(first) + [""]).encode())
            number += 1

        for row in iterator:
            name = row.structure_id
            if not name or "/" in name or self.packed and len(name.splitlines()) > 1:
                raise ValueError(f"no name for a file: {name!r}")
            text = cif.text_of(row.asDict(recursive=True))
            if self.packed:
                held.setdefault(name[0], []).append(text)
                if len(held[name[0]]) == BLOCKS:
                    flush(name[0])
                continue
            with store.open_output_stream(f"{folder}/{name}.cif") as stream:
                stream.write(text.encode())
        for first in list(held):
            flush(first)
        return _Written(folder)

    def commit(self, messages) -> None:
        store, top = _place(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(top)) if not f.path.endswith("/_drafts")] if self.overwrite else []
        for message in messages:
            if message is not None:
                store.move(message.folder, f"{top}/{message.folder.rsplit('/', 1)[-1]}")
        for path in old:
            store.delete_dir(path) if store.get_file_info(path).type == fs.FileType.Directory else store.delete_file(path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, top = _place(self.path)
        for folder in (f"{top}/_drafts/{self.job}", f"{top}/_drafts", top):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class CifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cif"

    def schema(self) -> str:
        return cif.SCHEMA

    def reader(self, schema: StructType) -> CifReader:
        return CifReader(self.options["path"], self.options.get("names", "*"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> CifWriter:
        return CifWriter(self.options["path"], overwrite, self.options.get("packed", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CifSource)

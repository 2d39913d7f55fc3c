"""A data source that writes one file per row of ``name, content``, a folder per task instead of one per document.

A task writes below a hidden folder of its job. The commit moves the folders of the tasks
that count into place, one rename a task, and removes the rest; before it nothing is to be
read, and a failed attempt or job leaves nothing that is. Reading, the driver lists the folders
of the tasks, not their files; a task reads the files of a folder. Paths are those of pyarrow:
a shared mount, or a file system's URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SOURCE = "segmill_files"
SCHEMA = pa.schema([("name", pa.string()), ("content", pa.string())])
_DONE = "_SUCCESS"
# Files are handed on together up to so many bytes, or so many files.
BATCH_BYTES = 1 << 22
BATCH_FILES = 1_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path; ``file:/x`` is how Spark writes ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        files, folder = _place(self.path)
        return files, folder, f"{folder}/_attempts-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        context = TaskContext.get()
        files, _, attempts = self._open()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        files.create_dir(f"{attempts}/{folder}", recursive=True)
        for row in iterator:
            with files.open_output_stream(f"{attempts}/{folder}/{row.name}") as out:
                out.write(row.content.encode())
        return Written(folder)

    def commit(self, messages: list) -> None:
        files, folder, attempts = self._open()
        for message in messages:
            files.move(f"{attempts}/{message.folder}", f"{folder}/{message.folder}-{self.job}")
        self._clear()
        with files.open_output_stream(f"{folder}/{_DONE}"):
            pass

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files, _, attempts = self._open()
        files.create_dir(attempts, recursive=True)
        files.delete_dir(attempts)


def _shown(name: str) -> bool:
    """As Spark's own readers see it."""
    return not name.startswith((".", "_"))


@dataclass
class Folder(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        files, folder = _place(self.path)
        found = files.get_file_info(fs.FileSelector(folder))
        return [Folder(x.base_name) for x in found if x.type == fs.FileType.Directory and _shown(x.base_name)]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without documents
            return
        files, folder = _place(self.path)
        names, contents, size = [], [], 0
        for file in files.get_file_info(fs.FileSelector(f"{folder}/{partition.name}")):
            if file.type != fs.FileType.File or not _shown(file.base_name):
                continue
            with files.open_input_stream(file.path) as stream:
                content = stream.read()
            if names and (size + len(content) > BATCH_BYTES or len(names) == BATCH_FILES):
                yield self._batch(names, contents)
                names, contents, size = [], [], 0
            names.append(file.base_name)
            contents.append(content)
            size += len(content)
        if names:
            yield self._batch(names, contents)

    def _batch(self, names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary()).cast(pa.string())], schema=SCHEMA)


class FilePerRow(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def write_files(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``rows(name, content)`` as files below the folder ``path``; names must differ.

    ``mode``: ``error`` refuses a folder that holds files, ``append`` adds to it.
    """
    if mode not in ("error", "append"):
        raise ValueError("mode must be error or append")
    files, folder = _place(path)
    if mode == "error" and files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        raise FileExistsError(f"{path} holds files")
    rows.sparkSession.dataSource.register(FilePerRow)
    rows.select("name", "content").write.format(SOURCE).mode("append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of the files of a folder that ``write_files`` has filled."""
    spark.dataSource.register(FilePerRow)
    return spark.read.format(SOURCE).load(path)

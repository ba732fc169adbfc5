"""One file for each row, written by the tasks that hold the rows.

A Python data source: a task writes its files into a folder of its own attempt below ``_temporary``; when all tasks are
done the driver moves the files of the attempts that count to their places and writes ``_SUCCESS`` last.  An attempt that
is lost or beaten leaves nothing behind, and neither does a job that fails.  Contents never pass through the driver, and
names do a few thousand at a time, so that neither a task nor the driver holds more for more files.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.storage import ship

_NAMES = "_names"
DONE = "_SUCCESS"
#: Files that the driver moves at the same time.
MOVERS = 16
#: Names that it holds while it does so.
HELD = 4096


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which all executors reach, and the path in it; one without a scheme is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _checked(name: str | None) -> str:
    if not name or "\n" in name or name.startswith(("/", "_")) or ".." in name.split("/") or posixpath.normpath(name) != name:
        raise ValueError(f"not a path below the target: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt has left its files, and how many; their names lie beside them."""

    attempt: str
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root.rstrip("/"), overwrite, uuid.uuid4().hex
        store, path = place(self.root)
        store.create_dir(self._temporary(path), recursive=True)  # its end tells tasks that still run that the job is over

    def _temporary(self, path: str) -> str:
        return f"{path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = place(self.root)
        task = TaskContext.get()
        own = f"{self._temporary(path)}/{f'{task.partitionId()}-{task.taskAttemptId()}' if task else uuid.uuid4().hex}"
        made, files, names = set(), 0, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    where = f"{own}/{_checked(name)}"
                    job, there = store.get_file_info([self._temporary(path), where])
                    if job.type == fs.FileType.NotFound:
                        raise RuntimeError("the job has ended")
                    if there.type != fs.FileType.NotFound:
                        raise ValueError("two rows name the same file")
                    for folder in {own, posixpath.dirname(where)} - made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    if names is None:
                        names = store.open_output_stream(f"{own}/{_NAMES}", buffer_size=1 << 16)
                    with store.open_output_stream(where) as out:
                        if content.is_valid:
                            out.write(content.as_buffer())
                    names.write(f"{name}\n".encode())
                    files += 1
            if names is not None:
                names.close()
        except BaseException:
            if names is not None and not names.closed:
                names.close()
            if made and store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_dir(own)
            raise
        return Written(posixpath.basename(own), files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = place(self.root)
        attempts = [m for m in messages if m is not None and m.files]

        def names(m: Written) -> Iterator[tuple[str, ...]]:
            with io.TextIOWrapper(store.open_input_stream(f"{self._temporary(path)}/{m.attempt}/{_NAMES}"), "utf-8", newline="\n") as file:
                yield from batched((line[:-1] for line in file), HELD)

        def there(some: tuple[str, ...]) -> list[str]:
            return [f.path for f in store.get_file_info([f"{path}/{n}" for n in some]) if f.type != fs.FileType.NotFound]

        try:
            with ThreadPoolExecutor(MOVERS) as pool:
                if not self.overwrite:
                    for m in attempts:
                        for some in names(m):
                            for found in pool.map(there, [some[k::MOVERS] for k in range(MOVERS)]):
                                if found:
                                    raise FileExistsError(f"{found[0]} exists already")
                made: set[str] = {path}
                for m in attempts:
                    moved = f"{self._temporary(path)}/{m.attempt}"

                    def move(some: tuple[str, ...], moved: str = moved) -> None:
                        if not self.overwrite and (found := there(some)):
                            raise FileExistsError(f"two rows name {found[0]}")
                        for name in some:
                            store.move(f"{moved}/{name}", f"{path}/{name}")

                    for some in names(m):
                        for folder in {posixpath.dirname(f"{path}/{n}") for n in some} - made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                        list(pool.map(move, [some[k::MOVERS] for k in range(MOVERS)]))
            store.create_dir(path, recursive=True)
            store.open_output_stream(f"{path}/{DONE}").close()
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove what this job's tasks have left, and the folder for it unless another job is writing."""
        store, path = place(self.root)
        for folder in (self._temporary(path), f"{path}/_temporary"):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class RowFiles(DataSource):
    """``df.write.format("rowfiles").option("root", folder)`` for rows of path (below the folder) and content (binary)."""

    @classmethod
    def name(cls) -> str:
        return "rowfiles"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if "root" not in self.options:
            raise ValueError("option root is missing")
        if [(f.name, f.dataType.typeName()) for f in schema] != [("path", "string"), ("content", "binary")]:
            raise ValueError("rows of path (string) and content (binary) are needed")
        return FileWriter(self.options["root"], overwrite)


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Write ``content`` of each row to ``root/path``; tasks write, the driver only moves finished files.

    A path must be relative and not lead out of ``root``; two rows with one path, and without ``overwrite`` an existing
    file, are errors, and then nothing is written.  A null content is an empty file.  Readers may rely on ``_SUCCESS``,
    which comes last.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(RowFiles)
    rows.select("path", "content").write.format("rowfiles").mode("overwrite" if overwrite else "append").option("root", root).save()

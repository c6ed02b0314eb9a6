"""A sink of files that appear only when its job commits.

Each task attempt writes its files into a folder of its own under a hidden one. The commit renames the folders of the attempts
that count, one for each task, so that what the driver does follows the tasks, not the files; an abort deletes what
was staged (tasks still running then may leave hidden files). A reader that looks into folders (files.listed and files.loaded do) sees all of a job's files or none, but for
the time between the first and the last rename.
"""

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "committed_files"
#: Folders whose names begin so are passed over by readers.
HIDDEN = "_staged-"


@dataclass
class Staged(WriterCommitMessage):
    folder: str | None
    n_files: int
    n_bytes: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = self._store()
        own, names, size = f"{root}/{HIDDEN}{self.job}/{uuid.uuid4().hex}", set(), 0
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                if not name or os.path.basename(name) != name or name.startswith((".", "_")):
                    raise ValueError(f"not a file name: {name}")
                if name in names:
                    raise ValueError(f"two files of one name: {name}")
                if not names:
                    store.create_dir(own, recursive=True)
                names.add(name)
                raw = content.as_py() or b""
                with store.open_output_stream(f"{own}/{name}") as f:
                    f.write(raw)
                size += len(raw)
        return Staged(own if names else None, len(names), size)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        for k, m in enumerate(messages):
            if m is not None and m.folder:
                store.move(m.folder, f"{root}/job-{self.job}-{k:05d}")
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        staged = f"{root}/{HIDDEN}{self.job}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class FilesSink(DataSource):
    """options: path, a folder's URI that driver and executors can write to."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are only added")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """files: name, content. Writes each under folder once the whole job has gone well; a null content is an empty file. A
    name that is none, or that a task has twice, fails the job, which then leaves nothing (see names.settled for what to
    do about equal names of different tasks)."""
    files.sparkSession.dataSource.register(FilesSink)
    files.select("name", "content").write.format(FORMAT).mode("append").save(folder)

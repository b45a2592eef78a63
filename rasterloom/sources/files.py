"""Whole files as rows: a data source for pictures and encoded pictures.

    register(spark)
    spark.read.format("whole_files").option("path", folder).option("glob", "*.png").load()   # name, file_size, content
    rows.write.format("whole_files").option("path", folder).mode("append").save()            # of name and content

Reading is split by files: large ones are a partition each, small ones share one. Writing ends in a commit: tasks put their
files in a hidden folder of the job, and only when all have ended are they moved to their names, so neither a task that runs twice
nor a job that fails leaves a file that is read. A task that still writes while its job is given up may leave that
hidden folder behind. Paths may be addresses of any file system that Arrow knows.

Cases: files and folders whose names begin with _ or . are left out; an empty folder gives no rows; a null name or content, a
name twice in one job, or one that leads out of the folder raises and nothing is written; `append` replaces files of the
same name, `overwrite` removes all others too; no rows write nothing."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, file_size long, content binary"
#: Bytes of small files that are read by one task.
PORTION = 64 << 20


def _store(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store, inner.rstrip("/")


def _files(path: str) -> list[tuple[str, int]]:
    """Names below the folder and sizes, in order."""
    from pyarrow import fs

    store, top = _store(path)
    found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    names = ((f.path[len(top) + 1 :], f.size) for f in found if f.type == fs.FileType.File)
    return sorted((n, s) for n, s in names if not any(p[0] in "_." for p in n.split("/")))


@dataclass
class Portion(InputPartition):
    files: list

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, glob: str, portion: int):
        self.path, self.glob, self.portion = path, glob, portion

    def partitions(self) -> list[Portion]:
        out, size = [], 0
        for name, n in _files(self.path):
            if fnmatch.fnmatch(name.rsplit("/", 1)[-1], self.glob):
                if not out or size + n > self.portion:
                    out.append([])
                    size = 0
                out[-1].append((name, n))
                size += n
        return [Portion(files) for files in out] or [Portion([])]

    def read(self, partition: Portion) -> Iterator[tuple]:
        store, top = _store(self.path)
        for name, _ in partition.files:
            with store.open_input_file(f"{top}/{name}") as f:
                content = f.read()
            yield name, len(content), content


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, top = _store(self.path)
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        try:
            self._write(store, top, folder, names, iterator)
        except BaseException:
            if names:
                store.delete_dir(f"{top}/{folder}")
            raise
        return Written(folder, names)

    def _write(self, store, top: str, folder: str, names: list[str], iterator: Iterator) -> None:
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or content is None:
                raise ValueError("a file needs a name and a content")
            parts = name.split("/")
            if any(p in ("", ".", "..") for p in parts) or parts[0][0] in "_.":
                raise ValueError(f"no name of a file in this folder: {name}")
            store.create_dir("/".join([top, folder, *parts[:-1]]), recursive=True)
            with store.open_output_stream(f"{top}/{folder}/{name}") as f:
                f.write(bytes(content))
            names.append(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        mine = [(m.folder, n) for m in messages if m is not None for n in m.names]
        names = {n for _, n in mine}
        if len(names) < len(mine):
            self.abort(messages)
            raise ValueError("a name of a file came twice")
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for name, _ in _files(self.path):
                if name not in names:
                    store.delete_file(f"{top}/{name}")
        for folder, name in mine:
            if "/" in name:
                store.create_dir(f"{top}/{name.rsplit('/', 1)[0]}", recursive=True)
            store.move(f"{top}/{folder}/{name}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove the folder of the job, with what tasks have left there that did not end."""
        from pyarrow import fs

        store, top = _store(self.path)
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._path(), self.options.get("glob", "*"), int(self.options.get("portion", PORTION)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self._path(), overwrite)

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("whole_files needs the option path")
        return self.options["path"].rstrip("/")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WholeFiles)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """name, file_size and content of the files in a folder and those below."""
    register(spark)
    return spark.read.format("whole_files").option("path", folder).option("glob", glob).load()


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows of name and content as files."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("whole_files").option("path", folder).mode(mode).save()

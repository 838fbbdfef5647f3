"""Binary files out of rows: ``write.format("binary_files")`` of (name, content).

A task attempt writes to a folder of its own, so what a lost or repeated attempt leaves
is never seen.  The commit moves the files of the attempts that counted to their names
and takes all attempt folders away; a job that fails leaves none of its files.  Files of
several GB are written from rows of parts: rows with equal names, in the order of a
column ``part``, are one file if they are in one partition, one after another.

Defined cases: null content is an empty file; a name twice in different partitions, a
null or absolute name, and one that leaves the folder raise; an existing file is not
replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from quarry.sources.ranges import opened

#: Holds the attempts while a job runs; readers leave names with underscores out.
ATTEMPTS = "_attempts"


@dataclass
class Written(D.WriterCommitMessage):
    attempt: str
    names: list[str]


class BinaryWriter(D.DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict):
        if {"name", "content"} - set(schema.names):
            raise ValueError("columns name and content are needed")
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return opened(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = self._folder()
        attempt, names, out = uuid.uuid4().hex, [], None
        try:
            for row in iterator:
                name = row["name"]
                if not name or name.startswith("/") or any(part in ("", ".", "..") or part[0] in "._" for part in name.split("/")):
                    raise ValueError(f"no name of a file in the folder: {name!r}")
                if not names or names[-1] != name:
                    if name in names:
                        raise ValueError(f"the parts of {name} do not follow each other")
                    if out is not None:
                        out.close()
                    target = f"{root}/{ATTEMPTS}/{self.job}/{attempt}/{name}"
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(target)
                    names.append(name)
                out.write(row["content"] or b"")
        finally:
            if out is not None:
                out.close()
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._folder()
        pairs = [(m.attempt, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in pairs}) != len(pairs):
            self.abort(messages)
            raise ValueError("two partitions wrote one name")
        taken = [n for _, n in pairs if fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound]
        if taken:
            self.abort(messages)
            raise FileExistsError(taken[0])
        for folder in {f"{root}/{n}".rpartition("/")[0] for _, n in pairs}:
            fs.create_dir(folder, recursive=True)
        for attempt, name in pairs:
            fs.move(f"{root}/{ATTEMPTS}/{self.job}/{attempt}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._folder()
        mine = f"{root}/{ATTEMPTS}/{self.job}"
        if fs.get_file_info(mine).type == pafs.FileType.Directory:
            fs.delete_dir(mine)
        if fs.get_file_info(f"{root}/{ATTEMPTS}").type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(f"{root}/{ATTEMPTS}")):
            fs.delete_dir(f"{root}/{ATTEMPTS}")


class BinarySink(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> BinaryWriter:
        if overwrite:
            raise ValueError("files are written once: use mode append")
        return BinaryWriter(schema, self.options)


def write_files(df: DataFrame, path: str) -> None:
    """The files (name, content) in the folder ``path``; all of them or none."""
    df.sparkSession.dataSource.register(BinarySink)
    df.write.format("binary_files").mode("append").save(path)

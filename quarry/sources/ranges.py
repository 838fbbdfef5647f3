"""Files by byte ranges: a data source that splits files of any size and content, and files of which a task reads only what it asks for.

``spark.read.format("byte_ranges")`` gives the blocks of files: file, size (of the
file), start, length and content.  A partition is a range of a file, or some small
files, of about ``bytes`` bytes, and is read in blocks of ``block`` bytes; where a
file is cut does not depend on what is in it.  With a schema that leaves content out
(``.schema("file string, start long")``) nothing is opened.  Conditions on file, size,
start and length are taken while partitions are planned, so that ranges without a
wanted block are neither scheduled nor read.

``RangedFile`` stands for the bytes of a file in code that takes slices of them.

Paths are those of pyarrow's file systems: a local or mounted folder or its URI, or
the URI of an object store.  Names that begin with a dot or an underscore are left
out, as Spark does.

Defined cases: an empty file gives no blocks; a folder without files no rows; a missing
path raises; null conditions are never true.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a partition and of a block.
RANGE_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20
#: Bytes that a ranged file reads ahead, and that it hashes at once.
WINDOW, STEP = 64 << 10, 1 << 20

_COLUMNS = {"file": pa.string(), "size": pa.int64(), "start": pa.int64(), "length": pa.int64(), "content": pa.binary()}
_COMPARE: dict[type, Callable] = {
    D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le,
    D.In: lambda v, among: v in among, D.StringStartsWith: lambda v, head: v.startswith(head), D.StringEndsWith: lambda v, tail: v.endswith(tail),
}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):  # with one slash or three
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(name, size) of a file, or of all files in a folder, by name."""
    fs, inner = opened(path)
    head = path[: -len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = lambda f: any(part[:1] in "._" for part in f.path[len(inner) :].split("/") if part)
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and (f is info or not hidden(f)))


@dataclass
class Ranges(D.InputPartition):
    """(file, size, start, stop) of what one task reads."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        super().__init__(parts)
        self.parts = parts


class RangeReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.names
        self.path = options.get("path") or ""
        self.bytes, self.block = int(options.get("bytes") or RANGE_BYTES), int(options.get("block") or BLOCK_BYTES)
        if self.bytes % self.block:
            raise ValueError("bytes must be a multiple of block")
        self.conditions: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in ("file", "size", "start", "length"):
                self.conditions.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _wanted(self, *block: object) -> bool:
        values = dict(zip(("file", "size", "start", "length"), block, strict=True))
        return all(_COMPARE[kind](values[name], value) for name, kind, value in self.conditions)

    def _blocks(self, file: str, size: int, start: int, stop: int) -> list[tuple[int, int]]:
        every = ((at, min(self.block, stop - at)) for at in range(start, stop, self.block))
        return [(at, n) for at, n in every if self._wanted(file, size, at, n)]

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        small: list[tuple[str, int, int, int]] = []
        held = 0
        for file, size in files_of(self.path):
            for start in range(0, size, self.bytes):
                stop = min(size, start + self.bytes)
                if not self._blocks(file, size, start, stop):
                    continue
                if small and held + stop - start > self.bytes:
                    out.append(Ranges(small))
                    small, held = [], 0
                small.append((file, size, start, stop))
                held += stop - start
        return [*out, Ranges(small)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _COLUMNS[c]) for c in self.columns])
        for file, size, start, stop in partition.parts:
            source = RangedFile(file, size, window=0) if "content" in self.columns else None
            for at, n in self._blocks(file, size, start, stop):
                row = {"file": file, "size": size, "start": at, "length": n}
                if source is not None:
                    row["content"] = source[at : at + n]
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], _COLUMNS[c]) for c in self.columns], schema=schema)


class RangeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "file string, size long, start long, length long, content binary"

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(schema, self.options)


def read_ranges(spark: SparkSession, path: str, block: int = BLOCK_BYTES, columns: str | None = None) -> DataFrame:
    """The blocks of the files at ``path``, in partitions of spark.sql.files.maxPartitionBytes at most; ``columns``: a schema of those wanted."""
    spark.dataSource.register(RangeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    block = min(block, most)
    reader = spark.read.format("byte_ranges").options(bytes=most // block * block, block=block)
    return (reader.schema(columns) if columns else reader).load(path)


class RangedFile:
    """The bytes of a file, from ``first`` on; slices read what they need, and up to ``window`` bytes ahead of it."""

    def __init__(self, path: str, size: int | None = None, window: int = WINDOW):
        fs, inner = opened(path)
        self._file = fs.open_input_file(inner)
        self._first, self._size, self._window = 0, self._file.size() if size is None else size, window
        self._held, self._held_at = b"", 0
        self.bytes_read = 0

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, key: slice | int):
        if isinstance(key, int):
            return self[key : key + 1][0]
        start, stop, step = key.indices(self._size)
        if step != 1:
            raise ValueError("slices of ranged files have no step")
        return self._read(start, max(0, stop - start))

    def _read(self, start: int, n: int) -> bytes:
        at = start - self._held_at
        if at < 0 or at + n > len(self._held):
            self._file.seek(self._first + start)
            self._held, self._held_at, at = self._file.read(min(max(n, self._window), self._size - start)), start, 0
            self.bytes_read += len(self._held)
        return self._held[at : at + n]

    def part(self, start: int, stop: int) -> RangedFile:
        """The bytes from ``start`` to ``stop`` as a ranged file of their own, over the same handle."""
        own = object.__new__(RangedFile)
        own.__dict__.update(self.__dict__, _first=self._first + start, _size=stop - start, _held=b"", _held_at=0, bytes_read=0)
        return own

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for at in range(0, self._size, STEP):
            digest.update(self._read(at, min(STEP, self._size - at)))
        return digest.hexdigest()


def part(data: bytes | RangedFile, start: int, stop: int):
    return data.part(start, stop) if isinstance(data, RangedFile) else data[start:stop]


def sha256(data: bytes | RangedFile) -> str:
    return data.sha256() if isinstance(data, RangedFile) else hashlib.sha256(data).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file (below ``path``), size and sha256 of every file of a folder; a file is hashed as it is read, whatever its size."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, sizes = batch.column("file").to_pylist(), batch.column("size").to_pylist()
            digests = [RangedFile(f, n, window=0).sha256() for f, n in zip(files, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("size"), pa.array(digests, pa.string())], names=["file", "size", "sha256"])

    listed = spark.createDataFrame(files_of(path), "file string, size long").repartition("file")
    below = F.substring_index("file", f"{path.rstrip('/').rpartition('/')[2]}/", -1)
    return listed.mapInArrow(hashed, "file string, size long, sha256 string").withColumn("file", below)

"""Readers of page containers: files in, rows of pages and located rejects out.

A container is a signature, a page index at a place its family fixes, and for each
page a text span followed by a chain of image descriptors.  The index is read as
one structured array and checked as columns; only image chains are walked.  A page
that breaks a rule becomes a reject with the offset, the field and the kind of
fault, and pages before and after it are still returned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from quarry.sources.images import dib_size, jpeg_size
from quarry.sources.ranges import RangedFile, part, sha256


@dataclass(frozen=True)
class Family:
    """Where a family keeps its number of pages and its index; ``outlines_at``: a count of 308-byte records before the index."""

    name: str
    marks: tuple[tuple[int, bytes], ...]
    pages_at: int
    index_at: int
    outlines_at: int | None = None
    narrow_at: int | None = None


# Fixed values of the formats: markers and offsets of each family, and the size of an outline record.
FAMILIES = [
    Family("C8", ((0, b"\xc8\x00\x00\x00"),), 0x08, 0x50),
    Family("HN-A", ((0, b"HN\x00\x00"), (4, b"\x90\x01\x00\x00")), 0x90, 0x15C, outlines_at=0x158),
    Family("HN-B", ((0, b"HN\x00\x00"), (4, b"\xc8\x00\x00\x00")), 0x90, 0xD8, narrow_at=0x88),
]
OUTLINE_BYTES = 308
_WIDE = np.dtype([("text_offset", "<i4"), ("text_length", "<i4"), ("images", "<i2"), ("raw_10", "<u2"), ("raw_12", "<u4"), ("raw_16", "<u4")])
_NARROW = np.dtype([("text_offset", "<i4"), ("text_length", "<i4"), ("reserved", "<u4")])


class Fault(ValueError):
    """offset, field and kind: malformed, truncated, unsupported or limit."""

    def __init__(self, offset: int, field: str, kind: str):
        super().__init__(f"{field} at {offset}: {kind}")
        self.offset, self.field, self.kind = offset, field, kind


@dataclass(frozen=True)
class Limits:
    pages: int = 100_000
    images: int = 10_000
    span: int = 1 << 30
    side: int = 100_000


def family_of(data: bytes) -> Family:
    for f in FAMILIES:
        if all(data[at : at + len(mark)] == mark for at, mark in f.marks):
            return f
    raise Fault(0, "signature", "unsupported" if len(data) >= 8 else "truncated")


def _number(data: bytes, at: int, field: str) -> int:
    if at + 4 > len(data):
        raise Fault(at, field, "truncated")
    return struct.unpack("<i", data[at : at + 4])[0]


def page_index(data: bytes, limits: Limits = Limits()) -> tuple[Family, int, np.ndarray]:
    """The family, the index's offset and its rows."""
    family = family_of(data)
    pages = _number(data, family.pages_at, "page count")
    if pages <= 0:
        raise Fault(family.pages_at, "page count", "malformed")
    if pages > limits.pages:
        raise Fault(family.pages_at, "page count", "limit")
    at = family.index_at
    if family.outlines_at is not None:
        outlines = _number(data, family.outlines_at, "outline count")
        if outlines < 0:
            raise Fault(family.outlines_at, "outline count", "malformed")
        at += OUTLINE_BYTES * outlines
    kind = _WIDE
    if family.narrow_at is not None:
        word = _number(data, family.narrow_at, "index marker")
        if word not in (0, 0xC8):
            raise Fault(family.narrow_at, "index marker", "unsupported")
        kind = _NARROW if word == 0 else _WIDE
    if at + pages * kind.itemsize > len(data):
        raise Fault(at, "page index", "truncated")
    return family, at, np.frombuffer(data[at : at + pages * kind.itemsize], kind)


def images_of(data: bytes, at: int, count: int, floor: int, limits: Limits = Limits()) -> list[dict]:
    """The chain of ``count`` descriptors that starts at ``at``: each is followed, after a gap, by its payload, and the next by that."""
    out = []
    for number in range(1, count + 1):
        if at < floor:
            raise Fault(at, "image descriptor", "malformed")
        if at + 12 > len(data):
            raise Fault(at, "image descriptor", "truncated")
        kind, start, length = struct.unpack("<iii", data[at : at + 12])
        if kind not in (0, 1, 2, 3):
            raise Fault(at, "image type", "malformed" if kind < 0 else "unsupported")
        if start < at + 12:
            raise Fault(at + 4, "image offset", "malformed")
        if length <= 0 or length > limits.span:
            raise Fault(at + 8, "image length", "malformed" if length <= 0 else "limit")
        if start + length > len(data):
            raise Fault(at + 4, "image payload", "truncated")
        payload = part(data, start, start + length)
        size = {1: lambda p: (None, None)}.get(kind, jpeg_size if kind == 2 else dib_size)(payload)
        if size is None:
            raise Fault(start, "image dimensions", "malformed")
        if size[0] and max(size) > limits.side:
            raise Fault(start, "image dimensions", "limit")
        out.append({
            "image_number": number, "record_type": kind, "descriptor_offset": at, "gap_length": start - at - 12, "payload_offset": start, "payload_length": length,
            "payload_sha256": sha256(payload), "width": size[0], "height": size[1],
        })
        at = start + length
    return out


_BLANK = dict.fromkeys(["variant", "row_offset", "text_offset", "text_length", "text_sha256", "image_count", "images", "fault_offset", "fault_field", "fault_kind"])


def pages_of(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """A row for each page, or for a fault in it; a fault in the header is a row of its own with page 0."""
    try:
        family, index_at, rows = page_index(data, limits)
    except Fault as fault:
        yield _BLANK | {"page_number": 0, "fault_offset": fault.offset, "fault_field": fault.field, "fault_kind": fault.kind}
        return
    for i in range(len(rows)):
        yield _page(data, family, index_at, rows.nbytes, rows[i], i, limits)


def _page(data: bytes | RangedFile, family: Family, index_at: int, index_bytes: int, row: np.void, i: int, limits: Limits) -> dict:
    """The row of page ``i`` (from 0), or of a fault in it."""
    at, protected, narrow = index_at + i * row.dtype.itemsize, index_at + index_bytes, row.dtype == _NARROW
    start, length = int(row["text_offset"]), int(row["text_length"])
    count = 0 if narrow else int(row["images"])
    head = _BLANK | {"variant": family.name, "page_number": i + 1, "row_offset": at}
    try:
        if narrow and row["reserved"]:
            raise Fault(at + 8, "reserved word", "unsupported")
        if start < 0 or narrow and start < protected:
            raise Fault(at, "text offset", "malformed")
        if length < 0:
            raise Fault(at + 4, "text length", "malformed")
        if start + length > len(data):
            raise Fault(at, "text span", "truncated")
        if count < 0 or count > limits.images:
            raise Fault(at + 8, "image count", "malformed" if count < 0 else "limit")
        images = images_of(data, start + length, count, protected, limits)
        text = sha256(part(data, start, start + length)) if length else None
        return head | {"text_offset": start, "text_length": length, "text_sha256": text, "image_count": count, "images": images}
    except Fault as fault:
        return head | {"fault_offset": fault.offset, "fault_field": fault.field, "fault_kind": fault.kind}


_IMAGE = pa.struct([("image_number", pa.int32()), ("record_type", pa.int32()), ("descriptor_offset", pa.int64()), ("gap_length", pa.int64()), ("payload_offset", pa.int64()), ("payload_length", pa.int64()), ("payload_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
_PAGE = pa.schema([
    ("source", pa.string()), ("variant", pa.string()), ("page_number", pa.int32()), ("row_offset", pa.int64()), ("text_offset", pa.int64()), ("text_length", pa.int64()), ("text_sha256", pa.string()),
    ("image_count", pa.int32()), ("images", pa.list_(_IMAGE)), ("fault_offset", pa.int64()), ("fault_field", pa.string()), ("fault_kind", pa.string()),
])


def _per_file(rows_of, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("source"), batch.column("content"), strict=True):  # a file at a time
                found = rows_of(data.as_py()) if data.is_valid else [{"page_number": 0, "fault_offset": 0, "fault_field": "file", "fault_kind": "limit"}]
                rows = [{"source": name.as_py()} | {k: v for k, v in r.items() if k in schema.names} for r in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read


def files(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """(source, content) of files; content is null, and not read, where a file has more than ``most`` bytes, which readers report as a fault."""
    found = spark.read.format("binaryFile").load(path)
    large = found.where(F.col("length") > most).select(F.col("path").alias("source"), F.lit(None).cast("binary").alias("content"))
    return found.where(F.col("length") <= most).select(F.col("path").alias("source"), "content").unionByName(large)


def read_pages(contents: DataFrame) -> DataFrame:
    """Pages and rejects of (source, content) rows."""
    return contents.mapInArrow(_per_file(pages_of, _PAGE), from_arrow_schema(_PAGE))


# ---------------------------------------------------------------- pages by range

_PLACE = pa.schema([("source", pa.string()), ("page_number", pa.int32()), ("at", pa.int64()), ("fault_offset", pa.int64()), ("fault_field", pa.string()), ("fault_kind", pa.string())])


def _places(limits: Limits):
    """Of each container, from its header and index alone: where every page begins, or the header's fault as page 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("source").to_pylist():
                try:
                    _, _, rows = page_index(RangedFile(source), limits)
                    n, at = len(rows), rows["text_offset"].astype(np.int64)
                    fault = [None] * 3
                    numbers = np.arange(1, n + 1, dtype=np.int32)
                except Fault as f:
                    n, at, numbers, fault = 1, np.zeros(1, np.int64), np.zeros(1, np.int32), [f.offset, f.field, f.kind]
                yield pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array(numbers), pa.array(at), *[pa.array([v] * n, t.type) for v, t in zip(fault, list(_PLACE)[3:], strict=True)]], schema=_PLACE)

    return read


def _at_places(limits: Limits):
    """The pages of (source, page_number) rows; a file is opened once for rows that follow each other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = data = index = None
        for batch in batches:
            out = []
            for name, number in zip(batch.column("source").to_pylist(), batch.column("page_number").to_pylist(), strict=True):
                if name != source:
                    source, data = name, RangedFile(name)
                    index = page_index(data, limits)
                family, index_at, rows = index
                out.append({"source": name} | _page(data, family, index_at, rows.nbytes, rows[number - 1], number - 1, limits))
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return read


def read_pages_by_range(spark: SparkSession, path: str, range_bytes: int = 16 << 20, limits: Limits = Limits()) -> DataFrame:
    """Pages and rejects of the containers at ``path``, of any size: indexes first, then pages dealt by the range of the file in which they begin.

    A task reads the index of a container and the bytes of its own pages; payloads
    are hashed as they are read.  Damaged headers are rejects of page 0.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"))
    places = listed.repartition("source").mapInArrow(_places(limits), from_arrow_schema(_PLACE))
    good = places.where("fault_kind IS NULL").withColumn("range", F.floor(F.col("at") / range_bytes))
    dealt = good.repartition("source", "range").sortWithinPartitions("source", "at")
    pages = dealt.select("source", "page_number").mapInArrow(_at_places(limits), from_arrow_schema(_PAGE))
    faults = places.where("fault_kind IS NOT NULL").drop("at")
    return pages.unionByName(faults, allowMissingColumns=True)


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.where("fault_kind IS NULL")


def rejects(pages: DataFrame) -> DataFrame:
    return pages.where("fault_kind IS NOT NULL").select("source", "page_number", "fault_offset", "fault_field", "fault_kind")


# ---------------------------------------------------------------- outline records

_NAVIGATION = pa.schema([("source", pa.string()), ("ordinal", pa.int32()), ("title", pa.string()), ("page", pa.int32()), ("level", pa.int32()), ("fault_field", pa.string())])
# Fixed values of the format: the header's length, the places of its numbers, and the fields of an outline record.
_NAV_HEADER, _NAV_PAGES, _NAV_COUNT = 0x114, 16, 0x110
_NAV_RECORD = np.dtype([("title", "V256"), ("_", "V24"), ("page", "V12"), ("__", "V12"), ("level", "<i4")])


def _field(raw: bytes) -> bytes | None:
    text, end, _ = raw.partition(b"\0")
    return text if end and text else None


def outline_rows(data: bytes) -> Iterator[dict]:
    """Titles (GB 18030), pages and levels of a navigation table; faults name the field."""
    blank = {"ordinal": None, "title": None, "page": None, "level": None}
    if len(data) < _NAV_HEADER or data[:4] != b"CAJ\0":
        yield blank | {"fault_field": "header"}
        return
    pages, (count,) = struct.unpack_from("<I", data, _NAV_PAGES)[0], struct.unpack_from("<I", data, _NAV_COUNT)
    if _NAV_HEADER + count * _NAV_RECORD.itemsize > len(data) or not 0 < pages <= 100_000 or count > 100_000:
        yield blank | {"fault_field": "bounds"}
        return
    before = 0
    for i, record in enumerate(np.frombuffer(data, _NAV_RECORD, count, _NAV_HEADER)):
        title, page, level = _field(record["title"].tobytes()), _field(record["page"].tobytes()), int(record["level"])
        row = blank | {"ordinal": i, "level": level, "fault_field": None}
        try:
            row["title"] = None if title is None else title.decode("gb18030")
        except UnicodeDecodeError:
            title = None
        number = int(page) if page is not None and page.isdigit() else 0
        row["page"] = number
        if title is None:
            row["fault_field"] = "title"
        elif not 1 <= number <= pages:
            row["fault_field"] = "page"
        elif not 1 <= level <= before + 1:
            row["fault_field"] = "level"
        before = level
        yield row


def read_outlines(contents: DataFrame) -> DataFrame:
    return contents.mapInArrow(_per_file(outline_rows, _NAVIGATION), from_arrow_schema(_NAVIGATION))


# ---------------------------------------------------------------- masked documents

# Fixed values of the format: its mark, where the masked part begins, and the mask.
MASK_MARK, MASK_START, MASK = b"KDH 2.00", 254, b"FZHMEI"


@F.arrow_udf(T.BinaryType())
def unmask(content: pa.Array) -> pa.Array:
    """The document below a repeated mask; null without the mark."""
    out = []
    for one in content:
        data = one.as_py()
        if data is None or not data.startswith(MASK_MARK):
            out.append(None)
            continue
        body = np.frombuffer(data, np.uint8)[MASK_START:]
        out.append((body ^ np.resize(np.frombuffer(MASK, np.uint8), len(body))).tobytes())
    return pa.array(out, pa.binary())

"""Headers and rows of images, and bounded inflation."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

_PNM = re.compile(rb"\A(P[456])(?:\s+|#[^\n]*\n)+(\d{1,9})(?:\s+|#[^\n]*\n)+(\d{1,9})(?:(?:\s+|#[^\n]*\n)+(\d{1,5}))?\s")


def dib_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a one-bit bitmap with a 40-byte header and the palette white, black."""
    if len(data) <= 48:
        return None
    size, width, height, planes, depth, compression = struct.unpack("<IiiHHI", data[:20])
    good = size == 40 and width > 0 and height > 0 and (planes, depth, compression) == (1, 1, 0) and data[40:48] == b"\xff\xff\xff\0\0\0\0\0"
    return (width, height) if good else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the baseline frame header, if that comes before any scan."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data):
            return None
        marker, length = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
        if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xDA or length < 2 or at + 1 + length > len(data):
            return None
        if marker == 0xC0:
            height, width, parts = struct.unpack(">HHB", data[at + 4 : at + 9]) if length >= 8 else (0, 0, 0)
            return (width, height) if width and height and parts and length == 8 + 3 * parts else None
        at += 1 + length
    return None


PNM = pa.struct([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("most", pa.int32()), ("pixels", pa.binary())])


def parse_pnm(data: bytes | None) -> dict | None:
    """Kind, size and payload of a raw P4, P5 or P6 image whose payload has exactly the length that its header says; else null."""
    m = _PNM.match(data or b"")
    if not m or (m[1] == b"P4") != (m[4] is None):
        return None
    width, height, most = int(m[2]), int(m[3]), int(m[4] or 1)
    row = -(-width // 8) if m[1] == b"P4" else width * (3 if m[1] == b"P6" else 1)
    body = data[m.end() :]
    if not width or not height or not 0 < most < 256 or len(body) != row * height:
        return None
    return {"kind": m[1].decode(), "width": width, "height": height, "most": most, "pixels": body}


@F.arrow_udf(from_arrow_type(PNM))
def pnm(content: pa.Array) -> pa.Array:
    return pa.array([parse_pnm(c.as_py()) for c in content], PNM)


def visible_bits(body: bytes, width: int, height: int, stride: int) -> np.ndarray:
    """Rows of packed bits without what pads them: bytes beyond the width go, and the last byte's spare bits are 0."""
    used = -(-width // 8)
    rows = np.frombuffer(body, np.uint8, height * stride).reshape(height, stride)[:, :used].copy()
    if width % 8:
        rows[:, -1] &= 0xFF << (8 - width % 8) & 0xFF
    return rows


INFLATED = pa.struct([("status", pa.string()), ("consumed", pa.int64()), ("produced", pa.int64()), ("data", pa.binary())])
#: Bytes that are fed to the inflater at once.
FEED = 1 << 16


class Inflation:
    """A zlib stream that is fed in chunks, with how many bytes it took and gave; it stops at its end, at damage, or beyond ``limit`` bytes."""

    def __init__(self, limit: int):
        self.engine, self.limit = zlib.decompressobj(), limit
        self.parts: list[bytes] = []
        self.consumed = self.produced = 0
        self.damaged = False

    def feed(self, chunk: bytes) -> bool:
        """Whether more is wanted."""
        while chunk and self.produced <= self.limit and not self.engine.eof:
            try:
                part = self.engine.decompress(chunk, self.limit + 1 - self.produced)
            except zlib.error:
                self.damaged = True
                return False
            left = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            self.consumed += len(chunk) - len(left)
            self.produced += len(part)
            self.parts.append(part)
            chunk = left
        return self.produced <= self.limit and not self.engine.eof

    def status(self, size: int) -> str:
        """What became of a stream of ``size`` bytes."""
        if self.engine.eof and self.produced <= self.limit:
            return "VALID_COMPLETE_ZLIB" if self.consumed == size else "TRAILING_DATA"
        return "INVALID_ZLIB" if self.damaged else "OUTPUT_LIMIT" if self.produced > self.limit else "INCOMPLETE_ZLIB"


def inflate(limit: int):
    """A function from zlib data to its status (VALID_COMPLETE_ZLIB, INVALID_ZLIB, INCOMPLETE_ZLIB, TRAILING_DATA or OUTPUT_LIMIT), the bytes taken and given, and, if it is valid, the data of at most ``limit`` bytes."""

    def one(raw: bytes | None) -> dict | None:
        if raw is None:
            return None
        stream = Inflation(limit)
        for at in range(0, len(raw), FEED):
            if not stream.feed(raw[at : at + FEED]):
                break
        status = stream.status(len(raw))
        return {"status": status, "consumed": stream.consumed, "produced": stream.produced, "data": b"".join(stream.parts) if status == "VALID_COMPLETE_ZLIB" else None}

    @F.arrow_udf(from_arrow_type(INFLATED))
    def inflated(raw: pa.Array) -> pa.Array:
        return pa.array([one(r.as_py()) for r in raw], INFLATED)

    return inflated


DELTA = pa.struct([("changed", pa.int64()), ("largest", pa.int32()), ("total", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("right", pa.int32()), ("bottom", pa.int32())])


def raster_delta(width: int, channels: int = 1):
    """A function from two rasters of 8-bit samples and one width: changed pixels, the largest and total absolute difference and the bounds of change; null for different lengths."""

    def one(a: bytes | None, b: bytes | None) -> dict | None:
        if a is None or b is None or len(a) != len(b) or len(a) % (width * channels):
            return None
        d = np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).reshape(-1, width, channels)
        hit = d.any(2)
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        bounds = dict(zip(("left", "top", "right", "bottom"), (int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1) if len(rows) else (None,) * 4, strict=True))
        return {"changed": int(hit.sum()), "largest": int(d.max(initial=0)), "total": int(d.sum()), **bounds}

    @F.arrow_udf(from_arrow_type(DELTA))
    def delta(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], DELTA)

    return delta

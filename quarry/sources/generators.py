"""Controls: containers, masked documents and streams with known contents, built from columns."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.containers import MASK, MASK_MARK, MASK_START
from quarry.sources.records import write_stream


def container(pages: list[bytes]) -> bytes:
    """A C8 container of text pages."""
    head = bytearray(0x50)
    struct.pack_into("<I", head, 0, 0xC8)
    struct.pack_into("<i", head, 8, len(pages))
    at, index = 0x50 + 20 * len(pages), b""
    for page in pages:
        index += struct.pack("<iihHII", at, len(page), 0, 0, 0, 0)
        at += len(page)
    return bytes(head) + index + b"".join(pages)


def masked(data: bytes) -> bytes:
    return MASK_MARK.ljust(MASK_START, b"\0") + bytes(v ^ MASK[i % len(MASK)] for i, v in enumerate(data))


def _udf(f):
    @F.arrow_udf(T.BinaryType())
    def build(values: pa.Array) -> pa.Array:
        return pa.array([None if not v.is_valid else f(v.as_py()) for v in values], pa.binary())

    return build


#: Lines of a text as the pages of a container.
container_of_lines = _udf(lambda text: container([line.encode() for line in text.split("\n")]))
masked_text = _udf(lambda text: masked(text.encode()))
deflated_text = _udf(lambda text: zlib.compress(text.encode(), 1))
#: The text's code points as glyph codes.
glyph_stream_of = _udf(lambda text: write_stream(np.frombuffer(text.encode("utf-32-le"), "<u4")))

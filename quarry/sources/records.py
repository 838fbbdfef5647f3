"""Streams of four-byte records: positions and styles carried to glyphs, and how the stream ended.

A record is two little-endian words, tag and payload.  All records of a span are
taken as one array: carried values are the last ones before each glyph, found by a
running maximum of their places, and the span ends at the first record that is a
terminator or outside the grammar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# Fixed values of the format: tags of the controls, and the first tag that is no glyph.
POSITION, STYLE, END, NEUTRAL, CONTROLS = 0x8001, 0x8002, 0x8004, 0x801D, 0x8000

GLYPH = pa.struct([("offset", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("style", pa.int32()), ("code", pa.int32())])
#: No stream is longer: offsets, and the length of a binary value, have 31 bits.
LONGEST = (1 << 29) - 1
STREAM = pa.struct([("status", pa.string()), ("offset", pa.int32()), ("records", pa.int32()), ("glyphs", pa.list_(GLYPH))])
CODES = pa.struct([*list(STREAM)[:3], ("codes", pa.list_(pa.int32()))])
#: A payload has 16 bits: a control's glyph stands in a cell of this width, as far from its left as the number of its code's plane.
CELL = 32


def _carried(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last of ``values`` under ``mask`` up to each place; -1 before the first."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)
    return np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else 0, -1)


def _read(data: bytes, most: int) -> tuple[str, int, list[np.ndarray]]:
    """status, the record where reading stopped, and the columns of GLYPH."""
    words = np.frombuffer(data, "<u2", len(data) // 4 * 2).reshape(-1, 2).astype(np.int64)
    tag, payload = words[:, 0], words[:, 1]
    y, style = _carried(tag == POSITION, payload), _carried(tag == STYLE, payload)
    glyph = tag < CONTROLS
    known = np.isin(tag, [POSITION, STYLE]) | ((tag == NEUTRAL) & (payload == 0))
    stops = {"TERMINATOR": tag == END, "UNSUPPORTED": (glyph & ((y < 0) | (style < 0))) | ~(glyph | known | (tag == END))}
    first = {name: int(np.argmax(hit)) for name, hit in stops.items() if hit.any()}
    status, at = min(((n, i) for n, i in first.items()), key=lambda x: x[1], default=("MALFORMED", len(tag)))
    if at >= most:
        status, at = "LIMIT", most
    seen = glyph[:at].nonzero()[0]
    return status, at, [c.astype(np.int32) for c in (4 * seen, tag[seen], y[seen], style[seen], payload[seen])]


def _records(status: str, at: int) -> int:
    return at + (status in ("TERMINATOR", "UNSUPPORTED"))


def read_stream(data: bytes, most: int = 65_536) -> dict:
    """status (TERMINATOR, LIMIT, MALFORMED or UNSUPPORTED), the offset where reading stopped, records read and glyphs."""
    status, at, columns = _read(data, most)
    rows = [dict(zip(GLYPH.names, values, strict=True)) for values in zip(*(c.tolist() for c in columns), strict=True)]
    return {"status": status, "offset": 4 * at, "records": _records(status, at), "glyphs": rows}


def glyph_columns(data: bytes, most: int) -> tuple[str, int, list[list[int]]]:
    """status, the offset where reading stopped, and offsets, x, y and codes of the glyphs as lists."""
    status, at, (offset, x, y, _, code) = _read(data, most)
    return status, 4 * at, [c.tolist() for c in (offset, x, y, code)]


def _reader(kind: pa.StructType, most: int, kept: Callable[[list[np.ndarray]], list[np.ndarray]]):
    """A function of a stream that reads up to ``most`` records; ``kept`` makes the columns of the result's list from those of GLYPH."""
    item = kind.field(3).type.value_type
    fields = list(item) if pa.types.is_struct(item) else None

    def one(data: bytes) -> tuple[str, int, list[np.ndarray]]:
        status, at, columns = _read(data, most)
        return status, at, kept(columns)

    @F.arrow_udf(from_arrow_type(kind))
    def read(data: pa.Array) -> pa.Array:
        found = [one(d.as_py()) if d.is_valid else None for d in data]
        ends = np.cumsum([0, *(len(f[2][0]) if f else 0 for f in found)])
        columns = [pa.array(np.concatenate([np.zeros(0, np.int32), *(f[2][k] for f in found if f)])) for k in range(len(fields or [item]))]
        items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields) if fields else columns[0])
        heads = [pa.array([f and f[0] for f in found], pa.string()), pa.array([f and 4 * f[1] for f in found], pa.int32()), pa.array([f and _records(f[0], f[1]) for f in found], pa.int32())]
        return pa.StructArray.from_arrays([*heads, items], fields=list(kind), mask=pa.array([f is None for f in found], pa.bool_()))

    return read


def glyph_stream_to(most: int):
    """A function of a stream that reads up to ``most`` records."""
    return _reader(STREAM, most, list)


def code_stream_to(most: int):
    """A function of a stream of ``write_stream`` that reads up to ``most`` records and gives whole code points, a fifth of the bytes of all glyphs."""
    return _reader(CODES, most, lambda columns: [columns[1] % CELL << 16 | columns[4]])


glyph_stream = glyph_stream_to(65_536)


def write_stream(codes: Sequence[int], y: int = 100, style: int = 0x0421) -> bytes:
    """A stream of glyphs on one line, as a control."""
    codes = np.asarray(codes, np.int64)
    body = np.empty((len(codes) + 3, 2), "<u2")
    body[0], body[1], body[-1] = (POSITION, y), (STYLE, style), (END, 0)
    body[2:-1, 0], body[2:-1, 1] = (np.arange(len(codes)) * CELL + (codes >> 16)) % CONTROLS, codes & 0xFFFF
    return body.tobytes()

"""Glyphs as a page's registers have them: every glyph record with the position, style, axes, role, shear and gray that the records before it set.

All records of a stream are one array.  A register is the last value set before a
glyph, found by a running maximum of places; a style forgets the axes, so an axis
counts only if it was set after the last style.

Defined cases: null gives null; a register that nothing has set has its default
or is null; a stream that breaks the grammar gives its status and no glyphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# Fixed values of the format: what records set which register, the end mark, and the record of a colour, which has two slots.
POSITION, STYLE, AXIS_X, AXIS_Y, ROLE, ALPHABET, SHEAR = 0x8001, 0x8002, 0x8070, 0x8071, 0x801D, 0x80CE, 0x8024
END, COLOUR = 0x8004, 0x81FF
SHEARS = {0x2800: 0.0, 0x2815: 0.105, 0x281C: 0.225, 0x281D: 0.24}
#: Grays before and after a colour record.
GRAY = 68 / 255

GLYPH = pa.struct([
    ("place", pa.int32()), ("tag", pa.int32()), ("payload", pa.int32()), ("y", pa.int32()), ("style", pa.int32()), ("axis_x", pa.int32()), ("axis_y", pa.int32()), ("role", pa.int32()), ("alphabet", pa.int32()), ("shear", pa.float64()), ("gray", pa.float64()),
])
MODEL = pa.struct([("status", pa.string()), ("glyphs", pa.list_(GLYPH))])


def _last(mask: np.ndarray) -> np.ndarray:
    """The last place under ``mask`` up to each place; -1 before the first."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)


def modelled(data: bytes | None) -> dict | None:
    """OK, TRUNCATED (no end mark) or UNKNOWN_RECORD, and the glyphs."""
    if data is None:
        return None
    words = np.frombuffer(data, "<u2", len(data) // 4 * 2).astype(np.int64)
    tag, payload = words[::2], words[1::2]
    second = np.concatenate([[False], tag[:-1] == COLOUR]) if len(tag) else np.zeros(0, bool)  # what follows a colour record belongs to it
    ends = np.flatnonzero((tag == END) & ~second)
    if not len(ends):
        return {"status": "TRUNCATED", "glyphs": []}
    tag, payload, second = tag[: ends[0]], payload[: ends[0]], second[: ends[0]]
    setters = {name: _last((tag == t) & ~second) for name, t in (("y", POSITION), ("style", STYLE), ("axis_x", AXIS_X), ("axis_y", AXIS_Y), ("role", ROLE), ("alphabet", ALPHABET), ("shear", SHEAR), ("gray", COLOUR))}
    glyph = (tag < 0x8000) & ~second
    known = glyph | second | np.isin(tag, [POSITION, STYLE, AXIS_X, AXIS_Y, ROLE, ALPHABET, SHEAR, COLOUR])
    if not known.all() or not np.isin(payload[(tag == SHEAR) & ~second], list(SHEARS)).all():
        return {"status": "UNKNOWN_RECORD", "glyphs": []}
    at = np.flatnonzero(glyph)

    def value(name: str, after: str | None = None) -> list[int | None]:
        place = setters[name][at]
        least = setters[after][at] if after else np.full(len(at), -1)
        return [int(payload[p]) if p >= 0 and p > a else None for p, a in zip(place.tolist(), least.tolist(), strict=True)]

    columns = [
        at.tolist(), tag[at].tolist(), payload[at].tolist(), value("y"), value("style"), value("axis_x", "style"), value("axis_y", "style"), value("role"), value("alphabet"), [SHEARS[0x2800 if v is None else v] for v in value("shear")],
        [0.0 if p >= 0 else GRAY for p in setters["gray"][at].tolist()],
    ]
    return {"status": "OK", "glyphs": [dict(zip(GLYPH.names, row, strict=True)) for row in zip(*columns, strict=True)]}


def modelled_batch(data: pa.Array) -> pa.Array:
    """``modelled`` of many streams as one array of records; a register counts only if it was set in the glyph's own stream."""
    streams = [d if d is None else d[: len(d) // 4 * 4] for d in data.to_pylist()]
    sizes = np.array([0 if d is None else len(d) // 4 for d in streams], np.int64)
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, int(sizes.sum())
    words = np.frombuffer(b"".join(d for d in streams if d), "<u2").astype(np.int64)
    tag, payload, row = words[::2], words[1::2], np.repeat(np.arange(len(sizes)), sizes)
    first = starts[row]
    place = np.arange(n)
    second = np.zeros(n, bool)  # what follows a colour record belongs to it
    second[1:] = (tag[:-1] == COLOUR) & (row[1:] == row[:-1])
    stop = np.full(len(sizes), n + 1)
    np.minimum.at(stop, row[(tag == END) & ~second], place[(tag == END) & ~second])
    inside = place < stop[row]
    tags = {"y": POSITION, "style": STYLE, "axis_x": AXIS_X, "axis_y": AXIS_Y, "role": ROLE, "alphabet": ALPHABET, "shear": SHEAR, "gray": COLOUR}
    glyph = (tag < 0x8000) & ~second
    known = (glyph | second | np.isin(tag, list(tags.values()))) & ~((tag == SHEAR) & ~second & ~np.isin(payload, list(SHEARS)))
    bad = np.zeros(len(sizes), bool)
    bad[row[inside & ~known]] = True
    status = np.where(stop > n, "TRUNCATED", np.where(bad, "UNKNOWN_RECORD", "OK"))
    at = np.flatnonzero(glyph & inside & (status == "OK")[row])
    last = {name: _last((tag == t) & ~second)[at] for name, t in tags.items()}
    last = {name: np.where(p >= first[at], p, -1) for name, p in last.items()}
    there = {name: p >= 0 for name, p in last.items()}
    for name in ("axis_x", "axis_y"):
        there[name] &= last[name] > last["style"]

    def value(name: str) -> pa.Array:
        return pa.array(payload[np.maximum(last[name], 0)].astype(np.int32), mask=~there[name])

    shear = np.zeros(len(at))
    for code, angle in SHEARS.items():
        shear[there["shear"] & (payload[np.maximum(last["shear"], 0)] == code)] = angle
    fields = [pa.array((at - first[at]).astype(np.int32)), pa.array(tag[at].astype(np.int32)), pa.array(payload[at].astype(np.int32)), *[value(c) for c in ("y", "style", "axis_x", "axis_y", "role", "alphabet")], pa.array(shear), pa.array(np.where(there["gray"], 0.0, GRAY))]
    counts = np.bincount(row[at], minlength=len(sizes))
    glyphs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(GLYPH)))
    return pa.StructArray.from_arrays([pa.array(status.tolist(), pa.string()), glyphs], fields=list(MODEL), mask=pa.array([d is None for d in streams], pa.bool_()))


@F.arrow_udf(from_arrow_type(MODEL))
def glyph_model(data: pa.Array) -> pa.Array:
    return modelled_batch(data)

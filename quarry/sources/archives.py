"""Archives of named members: every local record is held against its central one, sizes and checksums are proved, and nothing may lie between.

Defined cases: null gives null; an archive without an end record, or whose records
do not fit, gives its status and the members read so far.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

# Fixed values of the format: what records begin with, and their layouts.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")

MEMBER = pa.struct([("name", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("status", pa.string()), ("data", pa.binary())])
ARCHIVE = pa.struct([("status", pa.string()), ("members", pa.list_(MEMBER))])


def _member(data: bytes, entry: tuple, name: bytes) -> tuple[dict, int]:
    """One member, and where its local record ends."""
    method, crc, packed, size, at = entry[4], entry[7], entry[8], entry[9], entry[16]
    row = {"name": name.decode("utf-8", "replace"), "size": size, "packed": packed, "status": "LOCAL_RECORD", "data": None}
    if data[at : at + 4] != LOCAL or at + _LOCAL.size > len(data):
        return row, -1
    local = _LOCAL.unpack_from(data, at)
    start = at + _LOCAL.size + local[9] + local[10]
    if data[at + _LOCAL.size : at + _LOCAL.size + local[9]] != name or (local[6], local[7], local[8]) != (crc, packed, size):
        return row, start + packed
    raw = data[start : start + packed]
    try:
        plain = raw if method == 0 else zlib.decompress(raw, -15) if method == 8 else None
    except zlib.error:
        plain = None
    good = plain is not None and len(plain) == size and zlib.crc32(plain) == crc
    return row | {"status": "PASS" if good else "CONTENT", "data": plain if good else None}, start + packed


def read_archive(data: bytes | None) -> dict | None:
    """COMPLETE, NO_END, CENTRAL_RECORD, or GAP where bytes belong to no record."""
    if data is None:
        return None
    at = data.rfind(END)
    if at < 0 or at + _END.size > len(data):
        return {"status": "NO_END", "members": []}
    count, size, central = (_END.unpack_from(data, at)[k] for k in (4, 5, 6))
    members, spans, place = [], [(central, central + size)], central
    for _ in range(count):
        if data[place : place + 4] != CENTRAL or place + _CENTRAL.size > at:
            return {"status": "CENTRAL_RECORD", "members": members}
        entry = _CENTRAL.unpack_from(data, place)
        name = data[place + _CENTRAL.size : place + _CENTRAL.size + entry[10]]
        member, stop = _member(data, entry, name)
        members.append(member)
        spans.append((entry[16], stop))
        place += _CENTRAL.size + entry[10] + entry[11] + entry[12]
    spans.sort()
    whole = spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == at
    return {"status": "COMPLETE" if whole else "GAP", "members": members}


@F.arrow_udf(from_arrow_type(ARCHIVE))
def archive(data: pa.Array) -> pa.Array:
    return pa.array([read_archive(d.as_py()) for d in data], ARCHIVE)


def write_archive(members: list[tuple[str, bytes]]) -> bytes:
    """For controls."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def archived(members: pa.Array) -> pa.Array:
    """An array of structs (name, data) as an archive."""
    return pa.array([None if not m.is_valid else write_archive([(x["name"], x["data"]) for x in m.as_py()]) for m in members], pa.binary())

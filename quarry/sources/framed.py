"""Length-framed streams of artifacts, and line protocols whose records must come in a certain order.

A framed stream is a run of frames, each a length of four bytes (the lowest first)
and as many bytes.  A line protocol is a text of lines of tab-separated fields, of
which the first is the record's kind.

Defined cases: null gives null; an empty stream has no frames and is COMPLETE.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

FRAMES = pa.struct([("status", pa.string()), ("frames", pa.list_(pa.binary()))])


def framed(parts: Column) -> Column:
    """An array of binary values as one stream."""
    digits = lambda p: F.lpad(F.hex(F.octet_length(p)), 8, "0")
    size = lambda p: F.concat(*[F.substring(digits(p), k, 2) for k in (7, 5, 3, 1)])
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.concat(size(p), F.hex(p))), ""))


def read_frames(data: bytes | None, most: int) -> dict | None:
    """COMPLETE, TRUNCATED or LIMIT (a frame of more than ``most`` bytes), and the whole frames up to there."""
    if data is None:
        return None
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if at + 4 > len(data) or (size <= most and at + 4 + size > len(data)):
            return {"status": "TRUNCATED", "frames": found}
        if size > most:
            return {"status": "LIMIT", "frames": found}
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return {"status": "COMPLETE", "frames": found}


def frames(most: int = 1 << 24):
    """A function from streams to their status and frames."""

    @F.arrow_udf(from_arrow_type(FRAMES))
    def read(data: pa.Array) -> pa.Array:
        return pa.array([read_frames(d.as_py(), most) for d in data], FRAMES)

    return read


def protocol(text: Column, fields: dict[str, int], follows: dict[str, list[str]], last: list[str]) -> Column:
    """struct(status, line, counts): PASS, or what is wrong first (UNKNOWN_KIND, FIELD_COUNT, ORDER or UNFINISHED) and on which line, from 1; how many lines there are of each kind.

    ``fields``: how many fields a kind has, itself included; ``follows``: the kinds
    that may stand before it, "" for the beginning; ``last``: kinds that may end the text.
    """
    lines = F.transform(F.filter(F.split(text, "\n"), lambda line: line != ""), lambda line: F.split(line, "\t"))
    kinds = F.transform(lines, lambda f: F.get(f, F.lit(0)))
    before = F.concat(F.array(F.lit("")), kinds)
    number = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    allowed = F.create_map(*[x for k, v in follows.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def fault(f: Column, i: Column) -> Column:
        kind = F.get(f, F.lit(0))
        wanted = F.try_element_at(number, kind)
        return F.when(wanted.isNull(), "UNKNOWN_KIND").when(wanted != F.size(f), "FIELD_COUNT").when(~F.array_contains(F.try_element_at(allowed, kind), F.get(before, i)), "ORDER")

    found = F.filter(F.transform(lines, lambda f, i: F.struct((i + 1).alias("line"), fault(f, i).alias("fault"))), lambda x: x["fault"].isNotNull())
    first = F.get(found, F.lit(0))
    open_end = F.when(~F.element_at(before, -1).isin(*last), "UNFINISHED")
    status = F.coalesce(first["fault"], open_end, F.lit("PASS"))
    count = lambda name: F.size(F.filter(kinds, lambda k: k == name))
    counts = F.struct(*[count(name).alias(name) for name in fields])
    return F.when(text.isNotNull(), F.struct(status.alias("status"), F.coalesce(first["line"], F.when(open_end.isNotNull(), F.size(lines))).alias("line"), counts.alias("counts")))

"""Portable documents as rows: objects, references, values, image draws, shown text, widths and code maps."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_TOKEN = re.compile(
    rb"\s*+(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<mark><<|>>|\[|\])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open>\()|(?P<comment>%[^\r\n]*)|(?P<word>[^\s()<>\[\]{}/%]+)|(?P<end>\Z))"
)


class Malformed(ValueError):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string after its opening bracket, and the place after it."""
    out, depth = bytearray(), 1
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += octal.end()
                continue
            c = data[at : at + 1]
            at += 1
            if c in (b"\n", b"\r"):
                continue
            out += escapes.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        out += c
    raise Malformed("a string has no end")


def _plain_name(raw: bytes) -> str:
    """A name with the characters that its marks stand for; a mark without two digits stands for itself."""
    if b"#" not in raw:
        return raw.decode("latin-1")
    first, *rest = raw.split(b"#")
    out = [first]
    for piece in rest:
        try:
            out.append(bytes.fromhex(piece[:2].decode("ascii")) + piece[2:] if len(piece) > 1 and not piece[:2].isspace() else b"#" + piece)
        except ValueError:
            out.append(b"#" + piece)
    return b"".join(out).decode("latin-1")


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, object, int]]:
    """(kind, value, place after): name, number, string, mark and word."""
    match = _TOKEN.match
    while at < len(data):
        m = match(data, at)
        if not m:
            raise Malformed(f"no token at {at}")
        kind, at = m.lastgroup, m.end()
        raw = m[kind]
        if kind == "number":
            yield kind, float(raw) if b"." in raw else int(raw), at
        elif kind == "word":
            yield kind, raw.decode("latin-1"), at
        elif kind == "name":
            yield kind, _plain_name(raw[1:]), at
        elif kind == "mark":
            yield kind, raw.decode(), at
        elif kind == "open":
            value, at = _string(data, at)
            yield "string", value, at
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw[1:-1])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at


def value(data: bytes, at: int = 0, deepest: int = 128) -> tuple[object, int]:
    """One value in JSON terms, and the place after it: names are {"name"}, strings {"hex"}, references {"ref": [object, generation]}, reals {"real"} with their text kept as a number."""
    stack: list[list] = [[]]
    kinds: list[str] = [""]
    place = at

    def simple(kind: str, v: object) -> object:
        if kind == "name":
            return {"name": v}
        if kind == "string":
            return {"hex": bytes(v).hex()}
        return {"real": v} if isinstance(v, float) else v

    for kind, v, place in tokens(data, at):
        if kind == "mark" and v in ("[", "<<"):
            if len(stack) > deepest:
                raise Malformed("too deep")
            stack.append([])
            kinds.append(str(v))
        elif kind == "mark":
            items, opened = stack.pop(), kinds.pop()
            if opened != {"]": "[", ">>": "<<"}[str(v)] or v == ">>" and (len(items) % 2 or any("name" not in k for k in items[::2] if isinstance(k, dict)) or not all(isinstance(k, dict) for k in items[::2])):
                raise Malformed("brackets do not match")
            stack[-1].append(items if v == "]" else {"dict": {k["name"]: x for k, x in zip(items[::2], items[1::2], strict=True)}})
        elif kind == "word" and v == "R":
            if len(stack[-1]) < 2 or not all(isinstance(x, int) for x in stack[-1][-2:]):
                raise Malformed("a bare R")
            generation, number = stack[-1].pop(), stack[-1].pop()
            stack[-1].append({"ref": [number, generation]})
        elif kind == "word":
            if v not in ("true", "false", "null"):
                if len(stack) == 1 and stack[0]:
                    break
                raise Malformed(f"the word {v}")
            stack[-1].append({"true": True, "false": False, "null": None}[str(v)])
        else:
            stack[-1].append(simple(kind, v))
        if len(stack) == 1 and not isinstance(stack[0][-1], int):
            return stack[0][-1], place
    if len(stack) != 1 or not stack[0]:
        raise Malformed("no whole value")
    return stack[0][0], place


def references(v: object, path: str = "$") -> Iterator[tuple[int, str]]:
    """(object, path) of every reference inside a value."""
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield from references(x, f"{path}[{i}]")
    elif isinstance(v, dict):
        if "ref" in v:
            yield v["ref"][0], path
        for k, x in v.get("dict", {}).items():
            yield from references(x, f"{path}.{k}")


def objects(data: bytes) -> Iterator[dict]:
    """A row for each object in file order: its value as JSON, its stream's size, hash and (for Flate) complete inflation, and the objects it refers to."""
    found = list(_OBJECT.finditer(data))
    for m, after in zip(found, [*found[1:], None], strict=False):
        body = data[m.end() : after.start() if after else len(data)]
        row = {"number": int(m[1]), "generation": int(m[2]), "offset": m.start(), "value": None, "kind": "value", "stream_bytes": None, "stream_sha256": None, "plain_sha256": None, "refs": [], "fault": None}
        try:
            v, end = value(body)
            row |= {"value": json.dumps(v, sort_keys=True, separators=(",", ":")), "refs": [{"object": o, "path": p} for o, p in references(v)]}
            head = re.match(rb"\s*stream\r?\n", body[end:])
            if head:
                raw = body[end + head.end() :]
                length = v["dict"].get("Length") if isinstance(v, dict) and "dict" in v else None
                raw = raw[:length] if isinstance(length, int) and raw[length : length + 12].lstrip().startswith(b"endstream") else raw[: max(raw.find(b"endstream"), 0)].rstrip(b"\r\n")
                row |= {"kind": "stream", "stream_bytes": len(raw), "stream_sha256": hashlib.sha256(raw).hexdigest()}
                if v["dict"].get("Filter") in ({"name": "FlateDecode"}, [{"name": "FlateDecode"}]):
                    engine = zlib.decompressobj()
                    plain = engine.decompress(raw, 1 << 28)
                    row["plain_sha256"] = hashlib.sha256(plain).hexdigest() if engine.eof and not engine.unused_data else None
        except (Malformed, zlib.error, KeyError, TypeError, RecursionError) as bad:
            row["fault"] = str(bad) or type(bad).__name__
        yield row


_ROWS = pa.schema([
    ("source", pa.string()), ("number", pa.int64()), ("generation", pa.int32()), ("offset", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("stream_bytes", pa.int64()), ("stream_sha256", pa.string()),
    ("plain_sha256", pa.string()), ("refs", pa.list_(pa.struct([("object", pa.int64()), ("path", pa.string())]))), ("fault", pa.string()),
])


def read_objects(contents: DataFrame) -> DataFrame:
    """Objects of (source, content) rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("source"), batch.column("content"), strict=True):
                rows = [{"source": name.as_py()} | r for r in objects(data.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    return contents.mapInArrow(read, from_arrow_schema(_ROWS))


def dangling(rows: DataFrame) -> DataFrame:
    """References to objects that the source does not have."""
    wanted = rows.select("source", F.col("number").alias("owner"), F.explode("refs").alias("r")).select("source", "owner", F.col("r.object").alias("number"), F.col("r.path").alias("path"))
    return wanted.join(rows.select("source", "number").distinct(), ["source", "number"], "left_anti")


# ---------------------------------------------------------------- page contents

DRAW = pa.struct([("ordinal", pa.int32()), ("name", pa.string()), ("matrix", pa.list_(pa.float64()))])


def _times(m: list[float], n: list[float]) -> list[float]:
    """``m`` in the space of ``n``."""
    rows = [(m[0], m[1], 0.0), (m[2], m[3], 0.0), (m[4], m[5], 1.0)]
    return [r[0] * n[c] + r[1] * n[2 + c] + r[2] * n[4 + c] for r in rows for c in (0, 1)]


def draws_of(content: bytes, deepest: int = 64) -> list[dict]:
    """Every drawn resource in order, with the matrix then in force."""
    now, saved, operands, out = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [], [], []
    for kind, v, _ in tokens(content):
        if kind != "word":
            operands.append((kind, v))
            continue
        if v == "q":
            if len(saved) >= deepest:
                raise Malformed("too many saved states")
            saved.append(now)
        elif v == "Q":
            if not saved:
                raise Malformed("no saved state")
            now = saved.pop()
        elif v == "cm":
            own = [float(x) for k, x in operands[-6:] if k == "number"]
            if len(own) != 6:
                raise Malformed("cm needs six numbers")
            now = _times(own, now)
        elif v == "Do" and operands and operands[-1][0] == "name":
            out.append({"ordinal": len(out), "name": operands[-1][1], "matrix": now})
        operands = []
    return out


@F.arrow_udf(from_arrow_type(pa.list_(DRAW)))
def image_draws(content: pa.Array) -> pa.Array:
    """Draws of page contents; null for a malformed one."""
    out = []
    for c in content:
        try:
            out.append(None if not c.is_valid else draws_of(c.as_py()))
        except Malformed:
            out.append(None)
    return pa.array(out, pa.list_(DRAW))


def shown_text(content: Column) -> Column:
    """Text shown by ``Tm <hex> Tj``, artifacts left out and ActualText in place of what it covers; ``content`` is text of one byte a character."""
    plain = F.regexp_replace(content, r"(?s)/Artifact\s+BMC.*?\bEMC\b", "")
    plain = F.regexp_replace(plain, r"(?s)/Span\s*<<\s*/ActualText\s*<(?:FEFF)?([A-Fa-f0-9]+)>\s*>>\s*BDC.*?\bEMC\b", "Tm <$1> Tj")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\bTm\s*<([A-Fa-f0-9]+)>\s*Tj\b")), lambda h: F.decode(F.unhex(h), "UTF-16BE"))


def width_rows(fonts: DataFrame, keys: list[str], value_json: str) -> DataFrame:
    """keys, code and width of width arrays (JSON text): ``c [w ...]`` from c on, and ``a b w`` for a to b."""

    def expand(text: str | None) -> list[tuple[int, float]]:
        v, out, at = json.loads(text or "[]"), {}, 0
        while at < len(v):
            if isinstance(v[at + 1], list):
                pairs, at = list(enumerate(v[at + 1], v[at])), at + 2
            else:
                pairs, at = [(c, v[at + 2]) for c in range(v[at], v[at + 1] + 1)], at + 3
            if any(c in out for c, _ in pairs):
                raise ValueError("widths overlap")
            out.update(pairs)
        return sorted((c, float(w)) for c, w in out.items())

    kind = pa.list_(pa.struct([("code", pa.int32()), ("width", pa.float64())]))

    @F.arrow_udf(from_arrow_type(kind))
    def widths(text: pa.Array) -> pa.Array:
        return pa.array([[{"code": c, "width": w} for c, w in expand(t.as_py())] for t in text], kind)

    return fonts.select(*keys, F.explode(widths(value_json)).alias("w")).select(*keys, "w.code", "w.width")


def identity_tiling(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and identity: whether (first, last, target) rows map 0 to 65535 to themselves without gap or overlap, surrogates left out."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("first", "last")
    expected = F.coalesce(F.lag("last").over(order) + 1, F.lit(0))
    steps = intervals.select(*keys, "first", "last", "target", F.when((expected == 0xD800) & (F.col("first") == 0xE000), 0xE000).otherwise(expected).alias("want"))
    good = (F.col("first") == F.col("want")) & (F.col("target") == F.col("first")) & (F.col("last") >= F.col("first"))
    return steps.groupBy(*keys).agg((F.bool_and(good) & (F.max("last") == 65535)).alias("identity"))

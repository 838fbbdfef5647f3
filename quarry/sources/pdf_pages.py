"""Pages of portable documents as rows: stroked segments, shown glyphs, image resources, cross-reference entries, operands without an end."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quarry.sources.pdf import Malformed, _string, _times, tokens

POINT = pa.list_(pa.float64())
STROKES = pa.struct([("order", pa.string()), ("segments", pa.list_(pa.struct([("from", POINT), ("to", POINT), ("width", pa.float64()), ("gray", pa.float64())])))])
PAGE_STATUS = pa.struct([("status", pa.string()), ("offset", pa.int64()), ("operator", pa.string())])
GLYPHS = pa.list_(pa.struct([("ordinal", pa.int32()), ("font", pa.string()), ("size", pa.float64()), ("matrix", pa.list_(pa.float64())), ("gray", pa.float64()), ("role", pa.string()), ("code", pa.int32())]))
OPERAND = pa.struct([("offset", pa.int64()), ("arrays", pa.int32()), ("dictionaries", pa.int32())])
ENTRY = pa.struct([("offset", pa.int64()), ("generation", pa.int32()), ("in_use", pa.bool_())])

_UNIT = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
_HEX_START = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]()]|<[0-9A-Fa-f\s]*(>?)")


# Operators that change nothing of what is returned.
HARMLESS = ["ET", "BX", "EX", "MP", "DP", "ri", "i"]


class Unsupported(Malformed):
    """An operator that is not understood: what follows it may be placed or painted otherwise."""

    def __init__(self, operator: str, offset: int):
        super().__init__(f"{operator} at {offset}")
        self.operator, self.offset = operator, offset


class _Page:
    """The state that operators of a page change, and what they show; any operator that is not understood ends the page."""

    def __init__(self):
        self.state = {"matrix": _UNIT, "gray": 0.0, "width": 1.0}
        self.saved: list[dict] = []
        self.text, self.font, self.size = _UNIT, "", 0.0
        self.roles: list[str] = []
        self.path: list[tuple[list[float], list[float]]] = []
        self.at = self.first = None
        self.order, self.segments, self.glyphs = [], [], []

    def run(self, content: bytes) -> _Page:
        operands: list = []
        for kind, v, after in tokens(content):
            if kind == "word":
                handler = getattr(self, f"do_{_NAMES.get(v, v)}", None)
                if handler:
                    handler(operands)
                elif v not in HARMLESS:
                    raise Unsupported(v, after - len(v))
                operands = []
            else:
                operands.append((kind, v))
        if self.saved:
            raise Malformed("a saved state is left")
        return self

    @staticmethod
    def numbers(operands: list, n: int) -> list[float]:
        found = [float(v) for k, v in operands[-n:] if k == "number"]
        if len(found) != n:
            raise Malformed(f"{n} numbers are wanted")
        return found

    def placed(self, x: float, y: float) -> list[float]:
        return _times([1.0, 0.0, 0.0, 1.0, x, y], self.state["matrix"])[4:]

    def do_save(self, _) -> None:
        self.saved.append(dict(self.state))

    def do_restore(self, _) -> None:
        if not self.saved:
            raise Malformed("no saved state")
        self.state = self.saved.pop()

    def do_cm(self, operands) -> None:
        self.state["matrix"] = _times(self.numbers(operands, 6), self.state["matrix"])

    def do_g(self, operands) -> None:
        self.state["gray"] = self.numbers(operands, 1)[0]

    do_G = do_g

    def do_w(self, operands) -> None:
        self.state["width"] = self.numbers(operands, 1)[0]

    def do_m(self, operands) -> None:
        self.at = self.first = self.placed(*self.numbers(operands, 2))

    def do_l(self, operands) -> None:
        to = self.placed(*self.numbers(operands, 2))
        if self.at is None:
            raise Malformed("a line from nowhere")
        self.path.append((self.at, to))
        self.at = to

    def do_h(self, _) -> None:
        if self.at is not None and self.at != self.first:
            self.path.append((self.at, self.first))
            self.at = self.first

    def do_S(self, _) -> None:
        if self.path:
            self.order.append("v")
        self.segments += [{"from": a, "to": b, "width": self.state["width"], "gray": self.state["gray"]} for a, b in self.path]
        self.do_n(_)

    def do_n(self, _) -> None:
        self.path, self.at, self.first = [], None, None

    def do_Do(self, _) -> None:
        self.order.append("i")

    def do_BT(self, _) -> None:
        self.text = _UNIT

    def do_Tf(self, operands) -> None:
        self.font, self.size = str(operands[-2][1]), self.numbers(operands, 1)[0]

    def do_Tm(self, operands) -> None:
        self.text = self.numbers(operands, 6)

    def do_BMC(self, operands) -> None:
        self.roles.append(str(operands[-1][1]) if operands else "")

    def do_EMC(self, _) -> None:
        if not self.roles:
            raise Malformed("no marked content")
        self.roles.pop()

    def do_Tj(self, operands) -> None:
        raw = bytes(operands[-1][1])
        if len(raw) % 2:
            raise Malformed("half a code")
        self.order.append("g")
        matrix = _times(self.text, self.state["matrix"])
        role = self.roles[-1] if self.roles else ""
        for k in range(0, len(raw), 2):
            self.glyphs.append({"ordinal": len(self.glyphs), "font": self.font, "size": self.size, "matrix": matrix, "gray": self.state["gray"], "role": role, "code": int.from_bytes(raw[k : k + 2], "big")})


# Operators whose names are no good names of methods.
_NAMES = {"q": "save", "Q": "restore"}


def _each(column: pa.Array, one, kind: pa.DataType) -> pa.Array:
    out = []
    for c in column:
        try:
            out.append(one(c.as_py()) if c.is_valid else None)
        except (Malformed, ValueError, IndexError, TypeError):
            out.append(None)
    return pa.array(out, kind)


def status_of(content: bytes) -> dict:
    """OK, UNSUPPORTED with the operator and its offset, or MALFORMED."""
    try:
        _Page().run(content)
    except Unsupported as u:
        return {"status": "UNSUPPORTED", "offset": u.offset, "operator": u.operator}
    except (Malformed, ValueError, IndexError, TypeError):
        return {"status": "MALFORMED"}
    return {"status": "OK"}


@F.arrow_udf(from_arrow_type(PAGE_STATUS))
def page_status(content: pa.Array) -> pa.Array:
    """What became of a page, for every one that ``strokes`` and ``glyphs`` give no rows of; null for null."""
    return pa.array([status_of(c.as_py()) if c.is_valid else None for c in content], PAGE_STATUS)


@F.arrow_udf(from_arrow_type(STROKES))
def strokes(content: pa.Array) -> pa.Array:
    """Stroked segments in page space, and the order in which strokes (v), texts (g) and images (i) are painted; null where ``page_status`` is not OK."""
    return _each(content, lambda c: {"order": "".join((p := _Page().run(c)).order), "segments": p.segments}, STROKES)


@F.arrow_udf(from_arrow_type(GLYPHS))
def glyphs(content: pa.Array) -> pa.Array:
    """Codes that are shown, two bytes each, with font, matrix, gray and the role of the content they are marked as; null where ``page_status`` is not OK."""
    return _each(content, lambda c: _Page().run(c).glyphs, GLYPHS)


def first_unfinished(data: bytes) -> dict | None:
    """The first hexadecimal operand without an end: its offset, and in how many arrays and dictionaries it is."""
    at, arrays, dictionaries = 0, 0, 0
    while m := _HEX_START.search(data, at):
        raw, at = m[0], m.end()
        if raw == b"(":
            try:
                _, at = _string(data, at)
            except Malformed:
                return None
        arrays += (raw == b"[") - (raw == b"]")
        dictionaries += (raw == b"<<") - (raw == b">>")
        if raw[:1] == b"<" and raw != b"<<" and not m[1]:
            return {"offset": m.start(), "arrays": arrays, "dictionaries": dictionaries}
    return None


@F.arrow_udf(from_arrow_type(OPERAND))
def unfinished_hex(content: pa.Array) -> pa.Array:
    return _each(content, first_unfinished, OPERAND)


def table_entry(data: bytes, at: int, number: int, most: int = 1 << 20) -> dict | None:
    """The entry of an object in the cross-reference table at an offset; null if it has none. At most ``most`` rows are passed."""
    head = re.compile(rb"\s*(\d{1,10}) (\d{1,10})\s*?\r?\n")
    if data[at : at + 4] != b"xref":
        raise Malformed("no table")
    at, passed = at + 4, 0
    while m := head.match(data, at):
        first, count = int(m[1]), int(m[2])
        passed += count
        if passed > most:
            raise Malformed("too many rows")
        if first <= number < first + count:
            row = re.fullmatch(rb"(\d{10}) (\d{5}) ([nf])[\r\n ]{2}", data[m.end() + 20 * (number - first) :][:20])
            if not row:
                raise Malformed("a row of another form")
            return {"offset": int(row[1]), "generation": int(row[2]), "in_use": row[3] == b"n"}
        at = m.end() + 20 * count
    return None


@F.arrow_udf(from_arrow_type(ENTRY))
def xref_entry(content: pa.Array, at: pa.Array, number: pa.Array) -> pa.Array:
    rows = pa.array([None if c is None or a is None or n is None else (c, a, n) for c, a, n in zip(content.to_pylist(), at.to_pylist(), number.to_pylist(), strict=True)], pa.struct([("c", pa.binary()), ("a", pa.int64()), ("n", pa.int64())]))
    return _each(rows, lambda r: table_entry(r["c"], r["a"], r["n"]), ENTRY)


def image_resources(resources: Column) -> Column:
    """array<struct(name, object, generation)> of the images that a resource dictionary, a value as JSON, names; sorted by name."""
    kind = "dict struct<XObject: struct<dict: map<string, struct<ref: array<int>>>>>"
    images = F.map_entries(F.from_json(resources, kind)["dict"]["XObject"]["dict"])
    return F.array_sort(F.transform(images, lambda e: F.struct(e["key"].alias("name"), e["value"]["ref"][0].alias("object"), e["value"]["ref"][1].alias("generation"))))


def profile_of(dictionary: Column, profile: dict[str, str]) -> Column:
    """EXACT where a dictionary, as JSON, has just these entries (values as JSON), else DIFFERENT, and NONE for null."""
    entries = F.from_json(dictionary, "dict map<string, string>")["dict"]
    same = F.size(entries) == len(profile)
    for name, text in profile.items():
        same = same & F.coalesce(F.try_element_at(entries, F.lit(name)) == text, F.lit(False))
    return F.when(dictionary.isNull(), "NONE").when(F.coalesce(same, F.lit(False)), "EXACT").otherwise("DIFFERENT")

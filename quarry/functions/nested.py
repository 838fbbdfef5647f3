"""Nested documents as flat rows: scalar leaves by path, outlines in pre-order, and the shape of XML."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

LEAVES = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
OUTLINE = pa.list_(pa.struct([("ordinal", pa.int32()), ("depth", pa.int32()), ("title", pa.string()), ("page", pa.int32())]))
SHAPE = pa.list_(pa.struct([("ordinal", pa.int32()), ("tag", pa.string()), ("attributes", pa.list_(pa.string())), ("text_bytes", pa.int32())]))


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is repeated")
    return found


def _load(text: str | None) -> object:
    return json.loads(text, object_pairs_hook=_once, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))) if text is not None else None


def flat(value: object, deepest: int = 128) -> list[tuple[str, str]]:
    """(path, JSON of the scalar) of every leaf, in order; an empty list or object is a leaf."""
    out, stack = [], [("$", value, 0)]
    while stack:
        path, v, depth = stack.pop()
        inside = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        children = [(f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]", x, depth + 1) for k, x in inside]
        if not children:
            out.append((path, json.dumps(v)))
        elif depth >= deepest:
            raise ValueError("too deep")
        stack += reversed(children)
    return out


def _or_null(f):
    def one(text):
        try:
            return f(text)
        except (ValueError, KeyError, TypeError, ET.ParseError, RecursionError):
            return None

    return one


@F.arrow_udf(from_arrow_type(LEAVES))
def leaves(text: pa.Array) -> pa.Array:
    """Leaves of strict JSON; null for text that is none, repeats a key or is nested too deep."""
    one = _or_null(lambda t: None if t is None else [{"path": p, "value": v} for p, v in flat(_load(t))])
    return pa.array([one(t.as_py()) for t in text], LEAVES)


def outline_rows(nodes: list, depth: int = 0) -> list[dict]:
    out, stack = [], [(n, depth) for n in reversed(nodes)]
    while stack:
        node, at = stack.pop()
        if at > 128:
            raise ValueError("too deep")
        out.append({"ordinal": len(out), "depth": at, "title": node["title"], "page": node.get("page")})
        stack += [(k, at + 1) for k in reversed(node.get("kids", []))]
    return out


@F.arrow_udf(from_arrow_type(OUTLINE))
def preorder(text: pa.Array) -> pa.Array:
    """[{title, page, kids}] in pre-order with depths; null for another form."""
    one = _or_null(lambda t: None if t is None else outline_rows(_load(t)))
    return pa.array([one(t.as_py()) for t in text], OUTLINE)


def shape_of(text: str) -> list[dict]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("entities are refused")
    return [{"ordinal": i, "tag": e.tag, "attributes": sorted(e.attrib), "text_bytes": len((e.text or "").encode())} for i, e in enumerate(ET.fromstring(text).iter())]


@F.arrow_udf(from_arrow_type(SHAPE))
def xml_shape(text: pa.Array) -> pa.Array:
    """Tags, attribute names and text sizes of XML without entities, contents left out; null for others."""
    one = _or_null(lambda t: None if t is None else shape_of(t))
    return pa.array([one(t.as_py()) for t in text], SHAPE)


def xml_pages(text: Column) -> Column:
    """Array of struct(number, width, height) of ``<document><page number="1"><MediaBox l b r t/></page>...``; null unless numbers run from 1 and boxes are positive."""
    schema = "page ARRAY<STRUCT<_number: INT, MediaBox: STRUCT<_l: DOUBLE, _b: DOUBLE, _r: DOUBLE, _t: DOUBLE>>>"
    pages = F.from_xml(text, schema)["page"]
    rows = F.transform(pages, lambda p: F.struct(p["_number"].alias("number"), (p["MediaBox"]["_r"] - p["MediaBox"]["_l"]).alias("width"), (p["MediaBox"]["_t"] - p["MediaBox"]["_b"]).alias("height")))
    good = F.forall(F.transform(rows, lambda r, i: (r["number"] == i + 1) & (r["width"] > 0) & (r["height"] > 0)), lambda g: F.coalesce(g, F.lit(False)))
    return F.when((F.size(rows) > 0) & good, rows)


def manifest_diff(before: DataFrame, after: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Paths at which two versions of nested documents differ, with hashes of what they hold."""
    from quarry.operators.trees import changed_leaves

    rows = lambda df: df.select(*keys, F.explode(leaves(text)).alias("l")).select(*keys, "l.path", "l.value")
    return changed_leaves(rows(before), rows(after), keys)

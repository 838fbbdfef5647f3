"""What surrounds documents: listings of their pages, rights wrappers, trailing packages, headers, and indexes that are made anew."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quarry.functions import nested

#: Most pages of a listing.
PAGES = 10_000
TITLES = pa.list_(pa.struct([("start", pa.int32()), ("codec", pa.string()), ("stop", pa.int32()), ("terminated", pa.bool_()), ("title", pa.string())]))


def listed_pages(text: Column) -> Column:
    """array<struct(page, object)> of a listing {"pages": [{"object", "contents"}]}, from 1; null without pages, or with more than PAGES."""
    pages = F.from_json(text, "pages array<struct<object: string, contents: array<string>>>")["pages"]
    rows = F.transform(pages, lambda p, i: F.struct((i + 1).alias("page"), p["object"].alias("object"), p["contents"].alias("contents")))
    return F.when(F.size(pages).between(1, PAGES), rows)


def wrapper_fields(xml: Column) -> Column:
    """array<struct(name, characters, bytes, sequence, whole_blocks)> of the leaf elements of a wrapper: how long a value is, as base64 how many bytes, whether these begin a long sequence and fill blocks of sixteen."""
    named = r"<([A-Za-z][A-Za-z0-9]*)>([^<]*)</\1>"
    names, values = F.regexp_extract_all(xml, F.lit(named), F.lit(1)), F.regexp_extract_all(xml, F.lit(named), F.lit(2))

    def field(name: Column, value: Column) -> Column:
        data = F.when(F.rlike(value, F.lit(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")) & (value != ""), F.unbase64(value))
        size = F.octet_length(data)
        return F.struct(name.alias("name"), F.length(value).alias("characters"), size.alias("bytes"), (F.hex(F.substring(data, 1, 2)) == "3082").alias("sequence"), (size % 16 == 0).alias("whole_blocks"))

    return F.zip_with(names, values, field)


def last_place(data: Column, mark: bytes) -> Column:
    """Where ``mark`` begins for the last time, from 0; null if it does not."""
    before = F.substring_index(F.decode(data, "ISO-8859-1"), mark.decode("latin-1"), -1)  # a character a byte
    at = F.octet_length(data) - len(mark) - F.char_length(before)
    return F.when(at >= 0, at)


def extents(data: Column, mark: bytes = b"%%EOF") -> Column:
    """struct(document, wrapper): the bytes up to and with the last end mark, and those behind it; null without one."""
    at = last_place(data, mark)
    return F.when(at.isNotNull(), F.struct((at + len(mark)).alias("document"), (F.octet_length(data) - at - len(mark)).alias("wrapper")))


def trailing_packages(rows: DataFrame, keys: list[str], data: str, mark: bytes) -> DataFrame:
    """keys, status and elements of the XML behind the last mark: NO_FINAL_MARKER, PARSED with how often each element comes, or UNRESOLVED."""
    at = last_place(F.col(data), mark)
    tail = F.when(at.isNotNull(), F.substring(data, at + len(mark) + 1, F.octet_length(data)).cast("string"))
    shaped = rows.select(*keys, at.alias("_at"), nested.xml_shape(tail).alias("_shape")).withColumn("_tags", F.transform("_shape", lambda e: e["tag"]))
    counts = F.transform(F.array_sort(F.array_distinct("_tags")), lambda t: F.concat(t, F.lit("="), F.size(F.filter("_tags", lambda x: x == t)).cast("string")))
    status = F.when(F.col("_at").isNull(), "NO_FINAL_MARKER").when(F.col("_shape").isNull(), "UNRESOLVED").otherwise("PARSED")
    return shaped.select(*keys, status.alias("status"), F.coalesce(F.array_join(counts, ","), F.lit("")).alias("elements"))


def fields_of(data: Column, layout: dict[str, tuple[int, int]]) -> Column:
    """A struct of little-endian numbers by name (offset, bytes); null where the data end before."""

    def number(at: int, size: int) -> Column:
        digits = F.concat(*[F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(size))])
        return F.when(F.octet_length(data) >= at + size, F.conv(digits, 16, 10).cast("long"))

    return F.struct(*[number(at, size).alias(name) for name, (at, size) in layout.items()])


def rebuilt_index(rows: DataFrame) -> DataFrame:
    """source, first, last, free and index of objects (source, number, offset, size): the range they fill, the first number that is free, and a new cross-reference table over their offsets."""
    numbered = rows.withColumn("next", F.lead("number").over(Window.partitionBy("source").orderBy("number")))
    line = F.concat(F.lpad(F.col("offset").cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    section = F.concat(F.col("number").cast("string"), F.lit(" 1\n"), line)
    found = numbered.groupBy("source").agg(F.min("offset").alias("first"), F.max(F.col("offset") + F.col("size")).alias("last"), (F.max("number") + 1).alias("free"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", section.alias("s")))), lambda r: r["s"]), "").alias("index"))
    return found.withColumn("index", F.concat(F.lit("xref\n"), F.col("index")))


def _unit_ends(record: np.ndarray, width: int) -> np.ndarray:
    """For every start the place of the first zero unit of ``width`` bytes counted from it, or the record's length."""
    zero = np.logical_and.reduce([record[k : len(record) - width + 1 + k] == 0 for k in range(width)])
    ends = np.full(len(record), len(record))
    for phase in range(width):  # units that begin at starts of one phase
        places = np.append(np.flatnonzero(zero[phase::width]) * width + phase, len(record))
        starts = np.arange(phase, len(record), width)
        ends[starts] = places[np.searchsorted(places[:-1], starts)]
    return ends


def _text(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return None


def title_windows(codecs: list[str]):
    """A function from a record to every title that may stand in it: for each start and codec the text up to a zero (or the end), where it can be decoded."""
    widths = {codec: 2 if codec.startswith("utf-16") else 1 for codec in codecs}

    def windows(record: bytes) -> list[dict]:
        units = np.frombuffer(record, np.uint8)
        ends = {width: _unit_ends(units, width).tolist() for width in set(widths.values())} if record else {}
        spans = [(start, codec, ends[widths[codec]][start]) for codec in codecs for start in range(len(record))]
        titles = [_text(record[start:stop], codec) for start, codec, stop in spans]
        return [{"start": start, "codec": codec, "stop": stop, "terminated": stop < len(record), "title": title} for (start, codec, stop), title in zip(spans, titles, strict=True) if title is not None]

    @F.arrow_udf(from_arrow_type(TITLES))
    def titles(records: pa.Array) -> pa.Array:
        return pa.array([windows(r.as_py()) if r.is_valid else None for r in records], TITLES)

    return titles

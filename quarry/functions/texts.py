"""Text evidence and escapes."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def evidence(text: Column) -> Column:
    """Code points, UTF-8 bytes and the hash of the UTF-32BE form."""
    return F.struct(F.length(text).alias("code_points"), F.octet_length(text).alias("bytes"), F.sha2(F.encode(text, "UTF-32BE"), 256).alias("utf32_sha256"))


def coverage(text: Column, characters: str) -> Column:
    """How often each of ``characters`` occurs: a map."""
    pairs = [x for c in characters for x in (F.lit(c), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))]
    return F.create_map(*pairs)


def code_points(text: Column) -> Column:
    """The distinct characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9]+)"))


def decode_name(raw: Column) -> Column:
    """``#xx`` escapes of a name to the characters with these codes; null for a bad escape.

    What stands between two marks begins with the two digits of the first one.
    """
    pieces = F.split(raw, "#")
    escaped = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    good = F.forall(escaped, lambda p: F.rlike(p, F.lit("^[0-9A-Fa-f]{2}")))
    shown = F.transform(escaped, lambda p: F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, 3, 1 << 30)))
    return F.when(good, F.concat(F.get(pieces, F.lit(0)), F.array_join(shown, "")))


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """NFC with line ends as LF."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")))


def decoder(codec: str):
    """A function from bytes to text by a Python codec such as gb18030, which Spark lacks; null where bytes are malformed."""

    def one(value: bytes | None) -> str | None:
        try:
            return None if value is None else value.decode(codec)
        except UnicodeDecodeError:
            return None

    @F.arrow_udf(T.StringType())
    def decode(data: pa.Array) -> pa.Array:
        return pa.array([one(v.as_py()) for v in data], pa.string())

    return decode

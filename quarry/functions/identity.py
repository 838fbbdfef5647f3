"""Hashes and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_identity(data: Column) -> Column:
    return F.struct(F.octet_length(data).alias("size"), F.sha2(data, 256).alias("sha256"))


def text_identity(text: Column) -> Column:
    return byte_identity(F.encode(text, "UTF-8"))


def git_blob_sha1(data: Column) -> Column:
    """SHA-1 of ``blob <size>``, a NUL and the bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def range_sha256(data: Column, offset: Column, length: Column) -> Column:
    """Of the bytes from ``offset`` (from 0); null if the range is not inside."""
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(data))
    return F.when(inside, F.sha2(F.substring(data, offset + 1, length), 256))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and a newline."""
    return F.concat(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), F.lit("\n"))


def value_sha256(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def row_order_sha256(rows: Column) -> Column:
    """Hashes of an array of binary rows from the top and from the bottom."""
    joined = lambda r: F.sha2(F.unhex(F.array_join(F.transform(r, F.hex), "")), 256)
    return F.struct(joined(rows).alias("top_down"), joined(F.reverse(rows)).alias("bottom_up"))

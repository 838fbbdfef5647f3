"""Headers of bilevel image segments as columns: big-endian fields and flag bits, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(data: Column, offset: int, size: int) -> Column:
    """The unsigned number of ``size`` bytes from ``offset`` (from 0); null if the data are shorter."""
    return F.when(F.octet_length(data) >= offset + size, F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long"))


def signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def bits(value: Column, shift: int, width: int = 1) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND((1 << width) - 1).cast("int")


def dictionary_header(data: Column) -> Column:
    """Of a symbol dictionary: flags and their fields, the adaptive pixel, exported and new symbols, and where the body starts."""
    flags = big_endian(data, 0, 2)
    return F.when(F.octet_length(data) >= 12, F.struct(
        flags.alias("flags"), bits(flags, 0).alias("huffman"), bits(flags, 1).alias("refinement_aggregate"), bits(flags, 8).alias("context_used"), bits(flags, 9).alias("context_retained"),
        bits(flags, 10, 2).alias("template"), bits(flags, 12).alias("refinement_template"), F.array(signed(big_endian(data, 2, 1), 8), signed(big_endian(data, 3, 1), 8)).alias("at"),
        big_endian(data, 4, 4).alias("exported"), big_endian(data, 8, 4).alias("new"), F.lit(12).alias("body_offset"), (F.octet_length(data) - 12).alias("body_length"),
    ))


def text_header(data: Column) -> Column:
    """Of a text region: its extent, flags, whether refinement is used and its instances."""
    flags = big_endian(data, 17, 2)
    names = ["width", "height", "x", "y"]
    return F.when(F.octet_length(data) >= 25, F.struct(
        *[big_endian(data, 4 * i, 4).alias(n) for i, n in enumerate(names)], big_endian(data, 16, 1).alias("region_flags"), flags.alias("flags"), bits(flags, 1).alias("refinement"),
        (bits(flags, 15) == 1).alias("anomalous"), big_endian(data, 19, 4).alias("instances"), F.lit(23).alias("body_offset"), (F.octet_length(data) - 23).alias("body_length"),
    ))

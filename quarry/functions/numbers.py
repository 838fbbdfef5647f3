"""Numbers, vectors and affine maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column) -> Column:
    """Exact decimal text: no trailing zeros, no exponent, no negative zero."""
    text = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.when(text.rlike(r"^-?0E-?[0-9]+$"), "0").otherwise(text)
    return F.when(plain.isin("-0", "0"), "0").otherwise(plain)


def residual(actual: Column, expected: Column) -> Column:
    """Largest absolute difference of two arrays of one length; null otherwise."""
    return F.when(F.size(actual) == F.size(expected), F.array_max(F.zip_with(actual, expected, lambda a, b: F.abs(a - b))))


def close(left: Column, right: Column, tolerance: float) -> Column:
    return F.abs(left - right) <= tolerance


def multiply(left: Column, right: Column) -> Column:
    """The product of two affine maps [a b c d e f], ``left`` first."""
    l, r = [left[i] for i in range(6)], [right[i] for i in range(6)]  # noqa: E741
    return F.array(
        l[0] * r[0] + l[1] * r[2], l[0] * r[1] + l[1] * r[3], l[2] * r[0] + l[3] * r[2], l[2] * r[1] + l[3] * r[3],
        l[4] * r[0] + l[5] * r[2] + r[4], l[4] * r[1] + l[5] * r[3] + r[5],
    )


def bit_field(word: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND((1 << width) - 1)


def repeats(span: Column, width: Column) -> Column:
    """The positions at which something of ``width`` starts to fill ``span``."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(span / width) - 1, F.lit(0)).cast("long")), lambda i: i * width)


def bit_difference(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def little_endian_words(data: Column, offset: int, count: int) -> Column:
    """``count`` unsigned 16-bit numbers from ``offset`` (from 0)."""
    word = lambda i: F.conv(F.hex(F.concat(F.substring(data, offset + 2 + 2 * i, 1), F.substring(data, offset + 1 + 2 * i, 1))), 16, 10).cast("int")
    return F.array(*[word(i) for i in range(count)])

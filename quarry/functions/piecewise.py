"""Piecewise linear functions with exact rational values: a numerator and a denominator, never a float.

A piece is a range of whole numbers and a line over it: (a / b) x + c / d.  Few pieces
are an expression, a tree of comparisons that finds a piece by bisection; many are a
table, met in slices of the order of x.  Pieces do not overlap, so no more of them are
repeated than there are borders, and a row is moved once.

Defined cases: outside all pieces, and for null, the value is null; pieces must not
overlap; a numerator beyond 64 bits raises.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.slices import borders, slice_of


@dataclass(frozen=True)
class Piece:
    """x from ``start`` up to, without, ``stop``: slope * x + offset."""

    start: int
    stop: int
    slope: Fraction
    offset: Fraction


def _divisors(n: int) -> list[int]:
    small = [d for d in range(1, math.isqrt(n) + 1) if n % d == 0]
    return sorted({*small, *(n // d for d in small)}, reverse=True)


def _line(x: Column, piece: Piece) -> Column:
    """struct(numerator, denominator) in lowest terms."""
    below = math.lcm(piece.slope.denominator, piece.offset.denominator)
    above = x.cast("long") * F.lit(int(piece.slope * below)) + F.lit(int(piece.offset * below))
    common = F.lit(1)
    for d in reversed(_divisors(below)):
        common = F.when(above % d == 0, d).otherwise(common) if d > 1 else common
    return F.struct(F.call_function("div", above, common).alias("numerator"), F.call_function("div", F.lit(below), common).cast("long").alias("denominator"))


def value(x: Column, pieces: list[Piece]) -> Column:
    """struct(numerator, denominator) of the piece that ``x`` is in."""
    ordered = sorted(pieces, key=lambda p: p.start)
    for p, q in zip(ordered, ordered[1:], strict=False):
        if p.stop > q.start:
            raise ValueError(f"pieces overlap at {q.start}")

    def among(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.when((x >= ordered[lo].start) & (x < ordered[lo].stop), _line(x, ordered[lo]))
        mid = (lo + hi) // 2
        return F.when(x < ordered[mid].start, among(lo, mid)).otherwise(among(mid, hi))

    if not ordered:
        return F.lit(None).cast("struct<numerator: bigint, denominator: bigint>")
    return F.when(x.isNotNull(), among(0, len(ordered)))


def piece_of(rows: DataFrame, x: str, pieces: DataFrame) -> DataFrame:
    """``rows`` with the columns of the piece (start, stop and others) that ``x`` is in, null where there is none.

    Rows and pieces are dealt once to slices of the order of x, a piece to each slice
    that it touches; in a slice the last start is carried forward.  Rows of one x are
    dealt by a salt, and those of an x that many share fill several slices.
    """
    others = [c for c in pieces.columns if c not in ("start", "stop")]
    kept = pieces.where("stop > start").select(F.col("start").cast("long").alias("_x"), F.struct("start", "stop", *others).alias("piece"))
    asked = rows.select(F.struct("*").alias("row"), F.col(x).cast("long").alias("_x"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    at = lambda place, salt: F.struct(place.alias("x"), salt.cast("long").alias("salt"))
    lowest, highest = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    first, last = at(F.col("_x"), lowest), at(F.col("piece.stop").cast("long") - 1, highest)
    own = at(F.col("_x"), F.col("_salt"))
    cut = borders(asked.select(own.alias("key")).unionByName(kept.select(first.alias("key"))))
    opened = kept.select(F.explode(F.sequence(slice_of(cut, first), slice_of(cut, last))).alias("slice"), "_x", F.lit(None).cast(rows.schema).alias("row"), "piece")
    both = opened.unionByName(asked.select(slice_of(cut, own).alias("slice"), "_x", "row", F.lit(None).cast(kept.schema["piece"].dataType).alias("piece")))
    before = Window.partitionBy("slice").orderBy("_x", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("piece", F.last("piece", ignorenulls=True).over(before)).where("row IS NOT NULL")
    return met.select("row.*", F.when(F.col("_x") < F.col("piece.stop"), F.col("piece")).alias("piece")).select(*[F.col(f"`{c}`") for c in rows.columns], "piece.*")

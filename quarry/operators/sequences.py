"""Ordered analytics: gaps, islands, carried state, sweeps and element-wise comparison of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.running import running


def sequence_faults(df: DataFrame, on: list[str], number: str, first: int = 0) -> DataFrame:
    """on, rows, distinct, lowest, highest and complete: whether the numbers are first, first + 1, ... without gap or repeat."""
    found = df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(number).alias("distinct"), F.min(number).alias("lowest"), F.max(number).alias("highest"))
    return found.withColumn("complete", (F.col("rows") == F.col("distinct")) & (F.col("lowest") == first) & (F.col("highest") - F.col("lowest") + 1 == F.col("rows")))


def level_faults(df: DataFrame, on: list[str], order: list[str], level: str) -> DataFrame:
    """Rows that are more than one level below the row before; the first may be at level 1."""
    window = Window.partitionBy(*on).orderBy(*order)
    return df.where(F.lit(True)).withColumn("_before", F.lag(level, 1, 0).over(window)).where(F.col(level) > F.col("_before") + 1).drop("_before")


def carry_forward(df: DataFrame, on: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """With each name of ``values``: its last non-null value up to the row."""
    return running(df, on, order, lasts=values)


def resettable(df: DataFrame, on: list[str], order: list[str], values: dict[str, Column], reset: Column) -> DataFrame:
    """As ``carry_forward``, but rows with ``reset`` forget all values before them: a value counts if it is not before the last reset."""
    place = F.struct(*[F.col(c) for c in order])
    held = {f"_v_{n}": F.when(v.isNotNull(), F.struct(place.alias("at"), v.alias("v"))) for n, v in values.items()}
    found = running(df, on, order, lasts={**held, "_reset": F.when(reset, place)})
    since = lambda n: F.when(F.col("_reset").isNull() | (F.col(f"_v_{n}.at") >= F.col("_reset")), F.col(f"_v_{n}.v"))
    return found.withColumns({n: since(n) for n in values}).drop("_reset", *held)


def adjacent(df: DataFrame, on: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """With ``before``: a struct of the row before's ``columns``."""
    return df.withColumn("before", F.lag(F.struct(*columns)).over(Window.partitionBy(*on).orderBy(*order)))


def sweep(df: DataFrame, on: list[str], start: str, stop: str, tie: list[str]) -> DataFrame:
    """With ``gap`` (positive: uncovered before this interval; negative: overlap): the distance to the furthest stop of all intervals before."""
    found = running(df, on, [start, stop, *tie], maxima={"gap": F.col(stop)}, before=True)
    return found.withColumn("gap", F.col(start) - F.col("gap"))


def islands(df: DataFrame, on: list[str], position: str) -> DataFrame:
    """on, start and length of each run of successive positions; repeated positions count once."""
    each = df.select(*on, position).distinct()
    window = Window.partitionBy(*on).orderBy(position)
    grouped = each.withColumn("_island", F.col(position) - F.row_number().over(window))
    return grouped.groupBy(*on, "_island").agg(F.min(position).alias("start"), F.count(F.lit(1)).alias("length")).drop("_island")


def tiles(df: DataFrame, on: list[str], first: str, last: str) -> DataFrame:
    """Rows that do not begin right after the row before ends."""
    window = Window.partitionBy(*on).orderBy(first, last)
    return df.withColumn("_end", F.lag(last).over(window)).where(F.col("_end").isNotNull() & (F.col("_end") + 1 != F.col(first))).drop("_end")


def cyclic_match(expected: Column, actual: Column) -> Column:
    """Whether ``actual``, repeated, is ``expected``; its length must divide."""
    n, m = F.size(expected), F.size(actual)
    each = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(expected, i).eqNullSafe(F.get(actual, i % F.greatest(m, F.lit(1)))))
    return F.when(n == 0, m == 0).when(m == 0, False).otherwise((n % m == 0) & each)


def first_difference(left: Column, right: Column) -> Column:
    """The first index (from 0) at which two arrays differ, the shorter length if one begins the other, else null."""
    shorter = F.least(F.size(left), F.size(right))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: (i < shorter) & ~F.get(left, i).eqNullSafe(F.get(right, i)))
    return F.coalesce(F.get(differs, F.lit(0)), F.when(F.size(left) != F.size(right), shorter))


def newer(value: Column, than: Column) -> Column:
    """Order of 32-bit counters that wrap: less than half a cycle ahead."""
    return F.pmod(value - than, F.lit(1 << 32)).between(1, (1 << 31) - 1)


def strictly_increasing(values: Column) -> Column:
    return values == F.array_sort(F.array_distinct(values))


def covers(values: Column, n: Column) -> Column:
    """Whether the values are 1 to n, each once, in any order."""
    return F.when(n == 0, F.size(values) == 0).otherwise(F.array_sort(values) == F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")))


def positions_differing(left: Column, right: Column) -> Column:
    """Indices (from 0) at which two binary values of one length differ."""
    n = F.octet_length(left)
    return F.when(n == F.octet_length(right), F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(left, i + 1, F.lit(1)) != F.substring(right, i + 1, F.lit(1))))

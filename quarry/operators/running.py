"""Running state over ordered rows of a key: sums, last values and maxima, also of keys that hold a large share of all rows.

Keys of few rows are windows.  Where a key has more than ``HOT_ROWS``, rows are
dealt by range of key and order, so its rows fill many slices; each slice is
summed up, a prefix over the slices of a key carries state into the next one, and
windows run inside slices.  A slice's border cuts one key at most, so what is
carried over has no more rows than there are slices, and is broadcast.

Defined cases: a null key is a key; null values change nothing; the first row has
a null last value and maximum; equal orders are in no defined order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stored import stored

HOT_ROWS = 1_000_000
#: Bytes that a row has at least, by Spark's estimate.
ROW_BYTES = 8


def _is_hot(df: DataFrame, base: DataFrame, hot_rows: int | None) -> bool:
    """Whether a key has more than ``hot_rows`` rows; an input too small for that is not counted."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ROW_BYTES * most:
        return False
    return (base.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > most


def running(
    df: DataFrame, on: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """``df`` with each name: the sum, last non-null value or maximum of its column up to the row, or of the rows ``before`` it."""
    sums, lasts, maxima = sums or {}, lasts or {}, maxima or {}
    values = {**sums, **lasts, **maxima}
    place = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    base = df.select(F.struct("*").alias("row"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)]).alias("key"), place.alias("at"), *[v.alias(f"v_{n}") for n, v in values.items()])
    inside = lambda *keys: Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def over(w) -> dict[str, Column]:
        folds = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(lasts, lambda v: F.last(v, ignorenulls=True)), **dict.fromkeys(maxima, F.max)}
        return {n: fold(F.col(f"v_{n}")).over(w) for n, fold in folds.items()}

    if not _is_hot(df, base, hot_rows):
        return base.select("row", *[c.alias(f"r_{n}") for n, c in over(inside("key")).items()]).select("row.*", *[F.col(f"r_{n}").alias(n) for n in values])
    dealt = stored(base.repartitionByRange("key", "at").withColumn("slice", F.spark_partition_id()), "slices")
    latest = lambda n: F.max(F.when(F.col(f"v_{n}").isNotNull(), F.struct("at", F.col(f"v_{n}").alias("v"))))["v"]
    parts = dealt.groupBy("key", "slice").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"v_{n}").alias(f"s_{n}") for n in sums], *[latest(n).alias(f"s_{n}") for n in lasts], *[F.max(f"v_{n}").alias(f"s_{n}") for n in maxima],
    )
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = [*[F.sum(f"s_{n}").over(earlier).alias(f"c_{n}") for n in sums], *[F.last(f"s_{n}", ignorenulls=True).over(earlier).alias(f"c_{n}") for n in lasts], *[F.max(f"s_{n}").over(earlier).alias(f"c_{n}") for n in maxima]]
    ahead = parts.select(F.col("key").alias("_key"), F.col("slice").alias("_slice"), F.count(F.lit(1)).over(earlier).alias("_earlier"), *carried).where("_earlier > 0")
    found = dealt.withColumns({f"r_{n}": c for n, c in over(inside("key", "slice")).items()})
    both = found.join(F.broadcast(ahead), F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")), "left")
    out = {n: F.when(F.col(f"r_{n}").isNotNull() | F.col(f"c_{n}").isNotNull(), F.coalesce(f"r_{n}", F.lit(0)) + F.coalesce(f"c_{n}", F.lit(0))) for n in sums}
    out |= {n: F.coalesce(f"r_{n}", f"c_{n}") for n in lasts} | {n: F.greatest(f"r_{n}", f"c_{n}") for n in maxima}
    return both.select("row", *[c.alias(f"r_{n}") for n, c in out.items()]).select("row.*", *[F.col(f"r_{n}").alias(n) for n in values])

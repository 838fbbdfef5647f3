"""Joins of independent measurements of the same things.

Equality is null-safe where a side may be missing.  As-of and lifetime joins are
sorts within a key, not range joins: both sides are put in one order and the last
opening is carried forward, so no row meets more than its own partner; see
``running`` for keys that hold many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.running import running


def left_with_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """All rows of ``left``; columns of a missing partner take ``defaults``."""
    found = right.withColumn("_found", F.lit(True))
    joined = left.join(found, on, "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("_found")


def bijection(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: keys on both sides, missing on the right, extra on the right, and repeated on either; a bijection has zeros but for matched."""
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, on, "full_outer")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return both.agg(
        count(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), count(F.col("_r").isNull()).alias("missing"), count(F.col("_l").isNull()).alias("extra"),
        count(F.col("_l") > 1).alias("repeated_left"), count(F.col("_r") > 1).alias("repeated_right"),
    )


def full_outer_diff(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """on, change (MISSING, ADDED, CHANGED or SAME) and the names of changed columns; keys are unique on each side."""
    a = left.select(*on, F.struct(*values).alias("_a"))
    b = right.select(*on, F.struct(*values).alias("_b"))
    both = a.join(b, on, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col("_a")[v].eqNullSafe(F.col("_b")[v]), v) for v in values]), lambda x: x.isNotNull())
    change = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "ADDED").when(F.size(changed) > 0, "CHANGED").otherwise("SAME")
    return both.select(*on, change.alias("change"), F.when(change == "CHANGED", changed).otherwise(F.array().cast("array<string>")).alias("columns"))


def temporal_pairs(first: DataFrame, second: DataFrame, on: list[str], clock: str, within: Column | None = None, width: str | None = None) -> DataFrame:
    """Pairs with equal keys, first before second; columns in structs ``a`` and ``b``.

    ``within``: an interval that the difference may not exceed.  ``width``: seconds
    as a number; both sides are then also matched by time bins of that width, so a
    hot key is spread over its bins.
    """
    a, b = first.select(F.struct(*first.columns).alias("a")), second.select(F.struct(*second.columns).alias("b"))
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
    order = [F.col(f"a.{clock}") < F.col(f"b.{clock}")]
    if within is not None:
        order.append(F.col(f"b.{clock}") <= F.col(f"a.{clock}") + within)
    if width is not None:
        bin_ = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (float(width) * 1e6)).cast("long")
        a = a.withColumn("_bin", F.explode(F.array(bin_(f"a.{clock}"), bin_(f"a.{clock}") + 1)))
        b = b.withColumn("_bin", bin_(f"b.{clock}"))
        return a.join(b, [*keys, a["_bin"] == b["_bin"], *order]).select("a", "b")
    return a.join(b, [*keys, *order])


def as_of(left: DataFrame, right: DataFrame, on: list[str], clock: str, tie: str, tolerance: Column | None = None) -> DataFrame:
    """Each row of ``left`` (struct ``a``) with the latest row of ``right`` (struct ``b``) of its key that is not later, or null; ``tie`` orders equal times, the largest wins."""
    one = left.select(*on, F.col(clock).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(*left.columns).alias("a"), F.lit(None).cast(F_struct(right)).alias("b"))
    two = right.select(*on, F.col(clock).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(F_struct(left)).alias("a"), F.struct(*right.columns).alias("b"))
    both = one.unionByName(two)
    matched = running(both.withColumnRenamed("b", "_b"), on, ["_at", "_side", "_tie"], lasts={"b": F.col("_b")}).where("_side = 1")
    if tolerance is not None:
        matched = matched.withColumn("b", F.when(F.col("_at") <= F.col(f"b.{clock}") + tolerance, F.col("b")))
    return matched.select("a", "b")


def F_struct(df: DataFrame):
    """The type of ``struct(df.*)``."""
    return df.schema


def lifetimes(events: DataFrame, on: list[str], order: list[str], opens: Column) -> DataFrame:
    """With ``lifetime``: the running number of the opening event that each event of a key falls under; 0 before the first."""
    return running(events, on, order, sums={"lifetime": F.when(opens, 1).otherwise(0)})


def live_count(events: DataFrame, on: list[str], order: list[str], delta: Column) -> DataFrame:
    """With ``live``: the running sum of openings and closings of a key; below 0 a closing lacks its opening."""
    return running(events, on, order, sums={"live": delta})


def positional(left: DataFrame, right: DataFrame, on: list[str], ordinal: str, compare: Callable[[Column, Column], Column]) -> DataFrame:
    """on, ordinal and equal for every position that either side has; a missing one is unequal."""
    a, b = left.select(*on, ordinal, F.struct(*left.columns).alias("a")), right.select(*on, ordinal, F.struct(*right.columns).alias("b"))
    both = a.join(b, [*on, ordinal], "full_outer")
    return both.select(*on, ordinal, F.coalesce(compare(F.col("a"), F.col("b")), F.lit(False)).alias("equal"))


def agree(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value: mappings that do not agree."""
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def partition_selected(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """All rows, with ``scope``: SELECTED if the key is among ``chosen``, else OUT_OF_SCOPE."""
    marked = chosen.select(*on).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, on, "left").withColumn("scope", F.when(F.col("_in"), "SELECTED").otherwise("OUT_OF_SCOPE")).drop("_in")

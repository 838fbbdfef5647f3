"""Integrity of inventories over time, and reports of paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stored import stored


def reaudit(before: DataFrame, after: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """key and status of every declared or found thing: PASS if its identity stayed, FAIL if it changed, MISSING or UNDECLARED if one side lacks it."""
    a, b = before.select(*key, F.struct(*identity).alias("_a")), after.select(*key, F.struct(*identity).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.select(*key, F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "UNDECLARED").when(F.col("_a").eqNullSafe(F.col("_b")), "PASS").otherwise("FAIL").alias("status"))


def by_kind(events: DataFrame, kind: str, status: str, statuses: list[str]) -> DataFrame:
    """A row for each kind with how many rows have each of ``statuses`` (known beforehand: one pass, no look at the data)."""
    return events.groupBy(kind).agg(*[F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses], F.count(F.lit(1)).alias("attempted"))


def counter_delta(before: Column, after: Column) -> Column:
    """after - before; null if the counter was reset."""
    return F.when(after >= before, after - before)


def folded(rows: DataFrame, by: list[str], good: Column) -> DataFrame:
    """by, rows, good rows and whether all are good; a group without any row does not appear."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("good"), F.coalesce(F.bool_and(good), F.lit(False)).alias("all_good"))


def stability(first: DataFrame, second: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Two observations of the same things: STABLE if both exist and agree, UNSTABLE if they differ, NOT_CONFIRMED if one is missing; no row is lost."""
    a, b = first.select(*key, F.col(identity).alias("_a")), second.select(*key, F.col(identity).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.select(*key, F.when(F.col("_a").isNull() | F.col("_b").isNull(), "NOT_CONFIRMED").when(F.col("_a") == F.col("_b"), "STABLE").otherwise("UNSTABLE").alias("status"))


def role_of(rows: DataFrame, roles: DataFrame, name: str, default: str) -> DataFrame:
    """With ``role``: that of the row's name, else of the default name; of several roles of a name the least."""
    given = roles.groupBy(F.col("name").alias("_name")).agg(F.min("role").alias("_role"))
    fallback = roles.where(F.col("name") == default).agg(F.min("role").alias("_default"), F.lit(1).alias("_one"))
    joined = rows.withColumn("_one", F.lit(1)).join(given, F.col(name) == F.col("_name"), "left").join(F.broadcast(fallback), "_one", "left")  # an aggregate: one row
    return joined.withColumn("role", F.coalesce("_role", "_default")).drop("_name", "_role", "_default", "_one")


def chains(nodes: DataFrame, deepest: int = 1 << 20) -> DataFrame:
    """(head, node, place) of linked lists given as (node, next), by pointer doubling: log2(length) joins, and cycles are refused.

    A node that nobody points to heads a list; of several that point to one node, the least does.
    """
    pointed = nodes.where("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("up"))
    state = nodes.select("node").join(pointed, "node", "left").select("node", F.coalesce("up", "node").alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"))
    state, walked = stored(state, "lists"), 1
    while True:
        above = state.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        state = stored(state.join(above, "head").select("node", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), "lists")
        if state.where("moved").isEmpty():
            return state.select("head", "node", "place")
        walked *= 2
        if walked > deepest:
            raise ValueError("a list is cyclic or too long")

"""Budgets and effects: what is admitted before it is done, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.running import running


def admitted(events: DataFrame, on: list[str], order: list[str], most: Column, deadline: Column | None = None) -> DataFrame:
    """With ``admission``: ADMITTED for the first ``most`` events of a key that are not past their deadline, else OVER_LIMIT or TOO_LATE; late events do not count."""
    late = F.coalesce(deadline, F.lit(False)) if deadline is not None else F.lit(False)
    counted = running(events, on, order, sums={"_count": F.when(late, 0).otherwise(1)})
    return counted.withColumn("admission", F.when(late, "TOO_LATE").when(F.col("_count") <= most, "ADMITTED").otherwise("OVER_LIMIT")).drop("_count")


def within_budget(effects: DataFrame, on: list[str], order: list[str], size: Column, budget: Column) -> DataFrame:
    """With ``used`` (bytes up to and with the effect) and ``fits``: whether they are within the budget."""
    return running(effects, on, order, sums={"used": size}).withColumn("fits", F.col("used") <= budget)


def outcomes(log: DataFrame, on: list[str], order: str, status: str) -> DataFrame:
    """on and the last status of each effect of an append-only log; one that was admitted and never ended is UNKNOWN_AFTER_ADMISSION."""
    last = log.groupBy(*on).agg(F.max_by(status, order).alias("_last"))
    return last.select(*on, F.when(F.col("_last") == "ADMITTED", "UNKNOWN_AFTER_ADMISSION").otherwise(F.col("_last")).alias("status"))


def fresh(payload: Column, sentinel: Column, owner: Column, sentinel_owner: Column) -> Column:
    """Whether what was read is new: other than what was put there before, by another owner."""
    return F.coalesce((payload != sentinel) & (owner != sentinel_owner), F.lit(False))

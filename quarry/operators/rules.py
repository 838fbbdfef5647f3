"""Constraints as rows: every broken rule of every row, in one pass over the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``holds`` must be true; null counts as broken. A ``guard`` rule that is broken silences the row's other rules."""

    name: str
    holds: Column
    guard: bool = False


def violations(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """keys and rule, a row for each broken rule."""
    broken = lambda r: ~F.coalesce(r.holds, F.lit(False))
    guarded = F.lit(False)
    for r in rules:
        if r.guard:
            guarded = guarded | broken(r)
    names = F.array(*[F.when(broken(r) & (F.lit(True) if r.guard else ~guarded), r.name) for r in rules])
    return df.select(*keys, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("rule"))


def later_duplicates(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows that repeat an earlier row's ``by``; the first in ``order`` is not among them."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth > 1").drop("_nth")


def relative_path(path: Column) -> Column:
    """A canonical relative path: no root, drive, NUL, backslash, empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~path.rlike(r"[\\\x00:]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def decimal_text(value: Column, most: str = "2147483647") -> Column:
    """A plain decimal number of at most ``most``, without exponent."""
    return F.coalesce(value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$") & (F.abs(value.try_cast("decimal(38,18)")) <= F.lit(most).cast("decimal(38,18)")), F.lit(False))


def observed(status: Column, value: Column, valid: Column) -> Column:
    """A tagged value: OBSERVED, PINNED and REQUESTED must be valid; UNAVAILABLE and NOT_RUN must be null."""
    return F.when(status.isin("OBSERVED", "PINNED", "REQUESTED"), value.isNotNull() & valid).when(status.isin("UNAVAILABLE", "NOT_RUN"), value.isNull()).otherwise(False)


def exact_keys(mapping: Column, keys: list[str]) -> Column:
    return F.array_sort(F.map_keys(mapping)) == F.array(*[F.lit(k) for k in sorted(keys)])


def allowed_changes(changed: Column, allowed: list[str]) -> Column:
    """No changed key but the allowed ones."""
    return F.size(F.array_except(changed, F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"))) == 0

"""Status algebra: evidence that is missing never counts as success.

A fold keeps the worst status of a set; a status outside the order is worse than all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, NOT_RUN, UNSUPPORTED = "PASS", "FAIL", "NOT_RUN", "UNSUPPORTED"
#: From best to worst.
ORDER = [PASS, UNSUPPORTED, NOT_RUN, FAIL]


def rank(status: Column, order: list[str] = ORDER) -> Column:
    """The place in ``order``; after it for others and null."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(status, F.lit("")))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def label(rank_: Column, order: list[str] = ORDER) -> Column:
    return F.try_element_at(F.array(*map(F.lit, order)), rank_ + 1)


def fold(status: Column, order: list[str] = ORDER) -> Column:
    """Aggregate: the worst status; null if an unknown one is among them, and NOT_RUN of no rows."""
    return F.coalesce(label(F.max(rank(status, order)), order), F.when(F.count(F.lit(1)) == 0, NOT_RUN))


def verdict(present: Column, *checks: Column) -> Column:
    """NOT_RUN without evidence or with an unknown check, FAIL if a check fails, else PASS."""
    failed = F.lit(False)
    unknown = F.lit(False)
    for c in checks:
        failed, unknown = failed | F.coalesce(~c, F.lit(False)), unknown | c.isNull()
    return F.when(~F.coalesce(present, F.lit(False)), NOT_RUN).when(failed, FAIL).when(unknown, NOT_RUN).otherwise(PASS)


def outcome(equal: Column, comparable: Column, available: Column) -> Column:
    """DIFFERENT before INCOMPARABLE before UNAVAILABLE before EQUAL, of one pair."""
    return F.when(~available, "UNAVAILABLE").when(~comparable, "INCOMPARABLE").when(~equal, "DIFFERENT").otherwise("EQUAL")


def conversion(code: Column, diagnostic: Column, unsupported: list[str]) -> Column:
    """PASS on exit code 0; UNSUPPORTED on 1 with one of the phrases; else FAIL."""
    says = F.lit(False)
    for phrase in unsupported:
        says = says | F.contains(F.coalesce(diagnostic, F.lit("")), F.lit(phrase))
    return F.when(code.isNull(), NOT_RUN).when(code == 0, PASS).when((code == 1) & says, UNSUPPORTED).otherwise(FAIL)

"""Event streams: windowed counts with late data, correlation in bounded time, and reference-counted lifetimes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, clock: str, by: list[str], width: str, late: str, value: str) -> DataFrame:
    """n and total by window and key; events more than ``late`` behind the latest are left out."""
    return events.withWatermark(clock, late).groupBy(F.window(clock, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def correlate(first: DataFrame, second: DataFrame, on: str, clock: str, within: str, late: str) -> DataFrame:
    """Pairs with equal keys in which ``second`` follows ``first`` by at most ``within``; state older than that is dropped."""
    a = first.withWatermark(clock, late).alias("a")
    b = second.withWatermark(clock, late).alias("b")
    at, bt = F.col(f"a.{clock}"), F.col(f"b.{clock}")
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & (at < bt) & (bt <= at + F.expr(f"INTERVAL {within}")))


LIFETIME = "key string, opened long, closed long, live long, violations long"


def lifetimes(events: DataFrame, key: str, delta: str, order: str) -> DataFrame:
    """Per key, after each batch: openings, closings, how many are live, and closings without an opening.

    ``delta``: 1 opens and -1 closes.  Events of one batch are taken in ``order``.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, closed, live, violations = state.get if state.exists else (0, 0, 0, 0)
        for v in pd.concat(list(batches)).sort_values("_order")["_delta"]:
            if v > 0:
                opened, live = opened + 1, live + 1
            elif v < 0 and live > 0:
                closed, live = closed + 1, live - 1
            elif v < 0:
                violations += 1
        state.update((opened, closed, live, violations))
        yield pd.DataFrame({"key": [keys[0]], "opened": [opened], "closed": [closed], "live": [live], "violations": [violations]})

    rows = events.select(F.col(key).cast("string").alias("_key"), F.col(delta).cast("int").alias("_delta"), F.col(order).alias("_order"))
    return rows.groupBy("_key").applyInPandasWithState(step, LIFETIME, "opened long, closed long, live long, violations long", "update", GroupStateTimeout.NoTimeout)


ORDERED = "key string, opened long, closed long, live long, violations long"
_PENDING = "opened long, closed long, live long, violations long, times array<long>, deltas array<int>"


def ordered_lifetimes(events: DataFrame, key: str, delta: str, clock: str, late: str) -> DataFrame:
    """As ``lifetimes``, in the order of event time whatever batch an event comes in.

    An event waits until the watermark has passed it; equal times open before they
    close.  Events more than ``late`` behind are left out.  A key's state ends when
    nothing is live and nothing waits.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, closed, live, violations, times, deltas = state.get if state.exists else (0, 0, 0, 0, [], [])
        waiting = list(zip(times, deltas, strict=True))
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip((batch["_at"].astype("int64") // 1_000_000).tolist() if batch["_at"].dtype.kind == "M" else batch["_at"].tolist(), batch["_delta"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        ready = sorted((w for w in waiting if w[0] <= passed), key=lambda w: (w[0], -w[1]))
        waiting = [w for w in waiting if w[0] > passed]
        for _, change in ready:
            if change > 0:
                opened, live = opened + 1, live + 1
            elif change < 0 and live > 0:
                closed, live = closed + 1, live - 1
            elif change < 0:
                violations += 1
        if waiting or live:
            state.update((opened, closed, live, violations, [t for t, _ in waiting], [d for _, d in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(min(t for t, _ in waiting), passed + 1))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame({"key": [keys[0]], "opened": [opened], "closed": [closed], "live": [live], "violations": [violations]})

    rows = events.withWatermark(clock, late).select(F.col(key).cast("string").alias("_key"), F.col(delta).cast("int").alias("_delta"), F.col(clock).alias("_at"))
    return rows.groupBy("_key").applyInPandasWithState(step, ORDERED, _PENDING, "update", GroupStateTimeout.EventTimeTimeout)

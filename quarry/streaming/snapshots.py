"""Latest complete snapshot of each session, as a batch and as a stream with the same rules.

A snapshot comes in parts: session, tick, part, parts (how many it has) and the time of
the part.  Parts later than ``within`` after the first one do not count; a snapshot with
all its parts is complete, at the time of its last one; equal parts count once, at their
earliest time.  The latest complete snapshot of a session is the one with the greatest
time, of equal times the greatest tick.

The stream decides on a snapshot when the watermark has passed its first part by
``within``: then no part that counts can come any more, so what it says does not depend
on the order of arrival.  It gives a row a snapshot: COMPLETE if it is later than all
before, SUPERSEDED if a later one was complete already, INCOMPLETE if parts are missing.
Open snapshots are held in map state and end with their timer; what a session's latest
one was is held until the watermark has passed it by ``keep``.

Defined cases: parts behind the watermark are left out by Spark; a null part or time
does not count; a snapshot of no parts is never complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMPLETE, SUPERSEDED, INCOMPLETE = "COMPLETE", "SUPERSEDED", "INCOMPLETE"
DECIDED = "session string, tick long, at long, seen int, parts int, status string"


def decided(parts: DataFrame, within_ms: int) -> DataFrame:
    """session, tick, at (milliseconds), seen, parts and complete of every snapshot; ``parts``: session, tick, part, parts, at (timestamp)."""
    known = parts.where("part IS NOT NULL AND at IS NOT NULL").groupBy("session", "tick", "part").agg(F.min(F.unix_millis(F.col("at").cast("timestamp"))).alias("at"), F.max("parts").alias("parts"))
    first = known.groupBy("session", "tick").agg(F.min("at").alias("first"), F.max("parts").alias("parts"), F.collect_list("at").alias("times"))
    counted = F.filter("times", lambda t: t <= F.col("first") + within_ms)
    return first.select("session", "tick", F.array_max(counted).alias("at"), F.size(counted).alias("seen"), "parts", (F.size(counted) == F.col("parts")).alias("complete"))


def latest_complete(parts: DataFrame, within_ms: int) -> DataFrame:
    """session, tick and at of each session's latest complete snapshot."""
    found = decided(parts, within_ms).where("complete")
    return found.groupBy("session").agg(F.max(F.struct("at", "tick")).alias("s")).select("session", "s.tick", "s.at")


class Snapshots(StatefulProcessor):
    """Calls to the state store cost far more than rows do: a batch's rows are folded to snapshots first, each of which is one entry, and one timer stands for all snapshots that end later."""

    #: Snapshots of a session that are folded before they are written.
    FOLDED = 50_000

    def __init__(self, within_ms: int, keep_ms: int):
        self.within, self.keep = within_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "tick long", "parts int, part array<bigint>, at array<bigint>")
        self.last = handle.getValueState("last", "at long, tick long")

    def _write(self, folded: dict[int, tuple[int, dict[int, int]]], fresh: bool) -> None:
        ends = None
        for tick, (parts, times) in folded.items():
            known = None if fresh else self.open.getValue((tick,))
            if known is not None:
                parts = max(parts, known[0])
                for part, at in zip(known[1], known[2], strict=True):
                    times[part] = min(at, times.get(part, at))
            self.open.updateValue((tick,), (parts, list(times), list(times.values())))
            end = min(times.values()) + self.within
            ends = end if ends is None else min(ends, end)
        if ends is not None:
            self.handle.registerTimer(ends)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        folded: dict[int, tuple[int, dict[int, int]]] = {}
        fresh = not self.open.exists()
        for batch in rows:
            for tick, part, parts, at in zip(*(batch[c].tolist() for c in ("tick", "part", "parts", "ms")), strict=True):
                tick, part, parts, at = int(tick), int(part), int(parts), int(at)
                most, times = folded.get(tick, (parts, {}))
                times[part] = min(at, times.get(part, at))
                folded[tick] = max(most, parts), times
            if len(folded) >= self.FOLDED:
                self._write(folded, fresh)
                folded, fresh = {}, False
        self._write(folded, fresh)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, next_end = [], None
        for (tick,), (parts, _, at) in self.open.iterator():
            first = min(at)
            if first + self.within <= passed:
                counted = [t for t in at if t <= first + self.within]
                due.append((key[0], tick, max(counted), len(counted), parts, len(counted) == parts))
            else:
                next_end = first + self.within if next_end is None else min(next_end, first + self.within)
        if next_end is None:
            self.open.clear()
        else:
            self.handle.registerTimer(next_end)
            for row in due:
                self.open.removeKey((row[1],))
        latest = self.last.get() if self.last.exists() else None
        rows = []
        for session, tick, at, seen, parts, complete in sorted(due, key=lambda r: (r[2], r[1])):
            newer = complete and (latest is None or (at, tick) > tuple(latest))
            rows.append((session, tick, at, seen, parts, (COMPLETE if newer else SUPERSEDED) if complete else INCOMPLETE))
            latest = (at, tick) if newer else latest
        if rows and latest is not None:
            self.last.update(tuple(latest))
            self.handle.registerTimer(latest[0] + self.keep)
        elif latest is not None and latest[0] + self.keep <= passed and next_end is None:
            self.last.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["session", "tick", "at", "seen", "parts", "status"])


def snapshots(parts: DataFrame, within_ms: int, late: str, keep_ms: int | None = None) -> DataFrame:
    """A row for each snapshot of the stream ``parts`` (session, tick, part, parts, at), as soon as it is decided."""
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = parts.where("part IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).select(F.col("session").cast("string").alias("session"), F.col("tick").cast("long").alias("tick"), F.col("part").cast("long").alias("part"), F.col("parts").cast("int").alias("parts"), "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("session").transformWithStateInPandas(Snapshots(within_ms, within_ms if keep_ms is None else keep_ms), DECIDED, "Append", "EventTime")

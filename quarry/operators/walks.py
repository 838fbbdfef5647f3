"""Walks over object graphs that visit each object once, level by level, with limits, and chains of receipts that are checked whole.

``walk`` is a breadth-first search of many graphs at once.  A level joins the frontier
with the edges, folds what it meets to one row an object, the smallest source being the
parent, and takes those away that were visited before.  A hub on either side is a
key of that join alone: meetings are added up before they are shuffled.

``chains`` checks histories in which each step covers the one before.  A step's own
links are joins; what holds for a chain is found by doubling: after round k a step
knows the state of the 2 ** k steps up to it, and two segments that meet make one, so
a chain of n steps takes log2(n) rounds, each a join on a step's key.  Steps whose
chain has ended are met by others, but look for nothing themselves; steps that name
no predecessor or link are dealt over all tasks.

Defined cases: a root that has no edges is visited; roots may repeat; null ends of
edges are no edges; a graph without roots gives no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stored import discard, stored

COMPLETE, DEPTH_LIMIT, VISIT_LIMIT = "COMPLETE", "DEPTH_LIMIT", "VISIT_LIMIT"


def walk(edges: DataFrame, roots: DataFrame, most_depth: int = 64, most_visits: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """What is reached, and where each walk ended.

    edges: graph, source, target.  roots: graph, node.  The first result has graph,
    node, depth and parent (null for a root): the first ``most_visits`` objects of a
    graph in the order of depth and node.  The second has graph, status, visits,
    depth (of the last level with visits) and unvisited: how many objects of the next
    level were seen and not visited, which is 0 where the walk is complete.
    """
    links = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("graph", "source", "target")
    start = roots.select("graph", "node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["source"].dataType).alias("parent")).distinct()
    levels: list[DataFrame] = []
    stops: list[DataFrame] = []
    fresh, depth = start, 0
    while True:
        level, stop = _admitted(stored(fresh, "level"), levels, most_depth, most_visits, depth)
        frontier = level
        if stop is not None:
            level, stop = stored(level, "level"), stored(stop, "stops")
            stops.append(stop)
            frontier = level.join(stop.select("graph"), "graph", "left_anti")
        levels.append(level)
        if depth > most_depth or level.isEmpty():
            break
        depth += 1
        frontier = frontier.select("graph", F.col("node").alias("source"))
        met = frontier.join(links, ["graph", "source"]).groupBy("graph", F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        fresh = met.join(_all(levels).select("graph", "node"), ["graph", "node"], "left_anti").select("graph", "node", F.lit(depth).alias("depth"), "parent")
    reached = _all(levels)
    ends = reached.groupBy("graph").agg(F.count(F.lit(1)).alias("visits"), F.max("depth").alias("depth"))
    if not stops:
        return reached, ends.select("graph", F.lit(COMPLETE).alias("status"), "visits", "depth", F.lit(0).cast("long").alias("unvisited"))
    status = ends.join(_all(stops), "graph", "left").select("graph", F.coalesce("status", F.lit(COMPLETE)).alias("status"), "visits", "depth", F.coalesce("unvisited", F.lit(0)).alias("unvisited"))
    return reached, status


def _all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _admitted(met: DataFrame, levels: list[DataFrame], most_depth: int, most_visits: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """The objects of a level that are visited, and (graph, status, unvisited) of the walks that end before its end, if there are any."""
    counts = met.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    if depth > most_depth:
        return met.limit(0), counts.select("graph", F.lit(DEPTH_LIMIT).alias("status"), F.col("n").alias("unvisited"))
    seen = _all([level.select("graph") for level in levels] or [met.select("graph").limit(0)]).groupBy("graph").agg(F.count(F.lit(1)).alias("seen"))
    free = F.greatest(F.lit(0), F.lit(most_visits) - F.coalesce("seen", F.lit(0)))
    over = counts.join(seen, "graph", "left").select("graph", "n", free.alias("free")).where("n > free")
    if over.isEmpty():
        return met, None
    # Only walks over their limit are numbered; a literal limit comes first, so that no task gets more rows of a graph than may be visited.
    cut = met.join(over, "graph").withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy("node"))).where(F.col("place") <= most_visits)
    within = met.join(over.select("graph"), "graph", "left_anti").unionByName(cut.where("place <= free").select(*met.columns))
    return within, over.select("graph", F.lit(VISIT_LIMIT).alias("status"), (F.col("n") - F.col("free")).alias("unvisited"))


def tips(steps: DataFrame) -> DataFrame:
    """Steps that no other step follows; ``steps``: step and before."""
    return steps.join(steps.select(F.col("before").alias("step")).distinct(), "step", "left_anti")


def _looked_up(rows: DataFrame, key: str, table: DataFrame, to: str) -> DataFrame:
    """Left join of ``rows`` (with a step) by ``key`` with ``to`` of ``table``; rows without a key are dealt by their step, since the hash of null would bring all of them to one task."""
    dealt = rows.withColumn("_deal", F.when(F.col(key).isNull(), F.hash("step")).otherwise(0))
    met = table.withColumn("_meet", F.pmod(F.hash(to), F.lit(1)))  # always 0, but no literal, which would be no key of the join
    return dealt.join(met, (F.col(key) == F.col(to)) & (F.col("_deal") == F.col("_meet")), "left").drop("_deal", "_meet")


def step_checks(steps: DataFrame, links: dict[str, tuple[str, DataFrame]], covers: Column) -> DataFrame:
    """step, before and fault (the first that it has, in this order: a missing link, a missing predecessor, a digest that does not cover it).

    links: by name, the column of ``steps`` and the table (one column) whose value
    must be there.  covers: over the columns of ``steps`` and of the predecessor,
    under ``before_`` and their names, true where the digest is right; for a first
    step the latter are null.
    """
    found = steps
    faults = []
    for name, (column, table) in links.items():
        there = table.select(F.col(table.columns[0]).alias(f"_{name}")).where(F.col(f"_{name}").isNotNull()).distinct()
        found = _looked_up(found, column, there, f"_{name}")
        faults.append(F.when(F.col(f"_{name}").isNull(), f"{name} missing"))
    earlier = steps.select(*[F.col(c).alias(f"before_{c}") for c in steps.columns])
    both = _looked_up(found, "before", earlier, "before_step")
    faults.append(F.when(F.col("before").isNotNull() & F.col("before_step").isNull(), "predecessor missing"))
    faults.append(F.when(~F.coalesce(covers, F.lit(False)), "digest"))
    return both.select("step", "before", F.coalesce(*faults).alias("fault"))


def chains(checks: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """Of every tip: step, first (the chain's first step), length, faults, and broken and fault of the broken step nearest to the first; status PASS, FAIL or CYCLE.

    checks: step (unique), before and fault.  A missing predecessor ends a chain.  A
    chain that has not ended after ``longest`` steps counts as a cycle, and so does a
    ring, which has no tip: it gives one row, that of its smallest step.
    """
    checks = stored(checks, "checks")
    known = checks.select(F.col("step").alias("up"), F.lit(True).alias("_known"))
    ends = tips(checks).withColumn("_ends", F.lit(True))
    begun = _looked_up(checks, "before", known, "up").join(ends.select("step", "_ends"), "step", "left").select(
        "step", F.when(F.col("_known"), F.col("before")).alias("up"), F.col("step").alias("first"), F.lit(1).cast("long").alias("length"), F.when(F.col("fault").isNotNull(), 1).otherwise(0).cast("long").alias("faults"),
        F.when(F.col("fault").isNotNull(), F.struct(F.col("step").alias("step"), F.col("fault").alias("fault"))).alias("broken"), F.col("step").alias("least"),
        F.coalesce("_ends", F.lit(False)).alias("tip"),
    )
    state = stored(begun, "chains")
    for _ in range(math.ceil(math.log2(max(2, longest)))):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("step").alias("up"), F.col("up").alias("up2"), F.col("first").alias("first2"), F.col("length").alias("length2"), F.col("faults").alias("faults2"), F.col("broken").alias("broken2"), F.col("least").alias("least2"))
        met = state.where("up IS NOT NULL").join(above, "up").select(
            "step", F.col("up2").alias("up"), F.col("first2").alias("first"), (F.col("length") + F.col("length2")).alias("length"), (F.col("faults") + F.col("faults2")).alias("faults"),
            F.coalesce("broken2", "broken").alias("broken"), F.least("least", "least2").alias("least"), "tip",
        )
        longer = stored(met.unionByName(state.where("up IS NULL")), "chains")
        discard(state)
        state = longer
    status = F.when(F.col("up").isNotNull(), "CYCLE").when(F.col("faults") > 0, "FAIL").otherwise("PASS")
    told = state.where("tip OR up IS NOT NULL AND step = least")  # of a ring the smallest step; of what leads into one its tip
    return told.select("step", "first", "length", "faults", F.col("broken.step").alias("broken"), F.col("broken.fault").alias("fault"), status.alias("status"))

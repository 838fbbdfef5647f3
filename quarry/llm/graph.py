"""Connected components of an edge table, by hooking, pointer jumping and contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller,
    follows these pointers to their roots, and contracts the edges to roots; a
    star takes one round, a chain of n about log n.  Edges between nulls and loops
    are left out; an empty table gives an empty result.
    """
    live = materialise(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    total: DataFrame | None = None
    while not live.isEmpty():
        # By the larger end, the smallest neighbour; nodes without a smaller one are roots.
        hook = materialise(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        while True:
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("_top"))
            jumped = materialise(hook.join(above, "up", "left").select("node", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_moved")), "hooks")
            discard(hook)
            hook = jumped.select("node", "up")
            if jumped.where("_moved").isEmpty():
                break
        to = lambda end: hook.select(F.col("node").alias(end), F.col("up").alias(f"_{end}"))
        ends = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        left = materialise(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(live)
        live = left
        if total is None:
            total = hook
        else:  # roots of the rounds before may have moved; new nodes do not appear
            moved = hook.select(F.col("node").alias("up"), F.col("up").alias("_top"))
            older, total = total, materialise(total.join(moved, "up", "left").select("node", F.coalesce("_top", "up").alias("up")).unionByName(hook), "roots")
            discard(older)
            discard(hook)
    if total is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = total.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
    return total.select("node", F.col("up").alias("component")).unionByName(roots)

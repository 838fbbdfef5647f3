"""Hierarchies held as parent and child rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.stored import stored
from quarry.operators.status import FAIL, PASS


def ancestors(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(ancestor, node, distance) for all pairs above each other, by doubling: log2(depth) joins; refuses deeper or cyclic inputs.

    ``edges``: (parent, node), each node once.
    """
    reach = [edges.select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("distance"))]
    whole = lambda: functools.reduce(DataFrame.unionByName, reach)
    longest = 1
    while True:
        above = whole().select(F.col("ancestor").alias("top"), F.col("node").alias("ancestor"), F.col("distance").alias("d2"))
        # Pairs of distance up to `longest` give those up to twice that; only the longest are extended, so each pair is made once.
        tips = whole().where(F.col("distance") == longest)
        further = stored(tips.join(above, "ancestor").select(F.col("top").alias("ancestor"), "node", (F.col("distance") + F.col("d2")).alias("distance")), "further")
        if further.isEmpty():
            return whole()
        if longest * 2 > depth:
            raise ValueError("the hierarchy is cyclic or too deep")
        reach.append(further)
        longest *= 2


def descendant_counts(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(ancestor, n_descendants) of every node with descendants, in log2(depth) rounds of a row for each node.

    After round k a node knows how many nodes are less than 2 ** k below it, and
    its own ancestor at 2 ** k, to which it reports that number.
    """
    nodes = edges.select("node", F.col("parent").alias("far")).unionByName(edges.select(F.col("parent").alias("node")).distinct().join(edges.select("node"), "node", "left_anti").select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("far")))
    state = stored(nodes.withColumn("n", F.lit(1).cast("long")), "counts")
    reached = 1
    while not state.where("far IS NOT NULL").isEmpty():
        if reached > depth:
            raise ValueError("the hierarchy is cyclic or too deep")
        reported = state.where("far IS NOT NULL").groupBy(F.col("far").alias("node")).agg(F.sum("n").alias("below"))
        further = state.where("far IS NOT NULL").select(F.col("node").alias("far"), F.col("far").alias("next"))
        state = stored(state.join(reported, "node", "left").join(further, "far", "left").select("node", F.col("next").alias("far"), (F.col("n") + F.coalesce("below", F.lit(0))).alias("n")), "counts")
        reached *= 2
    return state.where("n > 1").select(F.col("node").alias("ancestor"), (F.col("n") - 1).alias("n_descendants"))


def dangling(references: DataFrame, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """References without a target."""
    return references.join(targets.select(F.col(target).alias("_target")).distinct(), F.col(reference) == F.col("_target"), "left_anti")


def backlinks(nodes: DataFrame) -> DataFrame:
    """Sibling lists (node, previous, next): status FAIL where a neighbour does not point back."""
    back = nodes.select(F.col("node").alias("next"), F.col("previous").alias("_previous"))
    return nodes.join(back, "next", "left").select("node", F.when(F.col("next").isNull() | F.col("_previous").eqNullSafe(F.col("node")), PASS).otherwise(FAIL).alias("status"))


def declared_counts(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """(node, declared) against (ancestor, n_descendants): nodes whose counts differ."""
    both = declared.join(counted.withColumnRenamed("ancestor", "node"), "node", "left").withColumn("found", F.coalesce("n_descendants", F.lit(0)))
    return both.where("found != declared").select("node", "declared", "found")


def changed_leaves(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Nested documents as (keys, path, value) rows: paths whose scalars differ, with the hashes of both."""
    a, b = before.withColumnRenamed("value", "_a"), after.withColumnRenamed("value", "_b")
    both = a.join(b, [*keys, "path"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*keys, "path", F.sha2(F.col("_a").cast("binary"), 256).alias("before"), F.sha2(F.col("_b").cast("binary"), 256).alias("after"))

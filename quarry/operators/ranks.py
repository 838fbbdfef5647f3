"""Quantiles and ordered digests of groups of any size: rows are dealt by range of (group, value), so a group that is all rows fills all partitions.

Both need a row's place in its group.  Rows dealt by range are numbered within their
slice, and a prefix sum over the slices of a group, a row each, gives what stands
before a slice.  A slice's border cuts one group at most, so these sums are as many as
groups and slices together.

Defined cases: null values have no rank; a group without values gives null quantiles;
an empty table gives an empty result; equal orders of a digest are put in the order of
their lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quarry.functions.stored import stored

#: Children of a node of a digest tree, and its levels: 2 ** 40 rows.
FAN, LEVELS = 1024, 4


def _placed(dealt: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """by, slice, before and held (weights of earlier slices and of this one), total (of the group); ``dealt``: with a column slice."""
    sums = dealt.groupBy(*by, "slice").agg(F.sum(weight).alias("held"))
    over = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "slice", "held", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(*by)).alias("total"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and quantiles (array<double>, as ``shares``): exact, with linear interpolation between neighbours.

    A value between low and high is low * (1 - part) + (high * part), of which the first
    product and the sum are rounded once, as in DuckDB's quantile_cont.

    Equal values are folded to one row with their number before rows are dealt; only
    the slices that hold a wanted rank are looked at again.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = stored(counted.repartitionByRange(*by, "_v").withColumn("slice", F.spark_partition_id()), "values")
    placed = stored(_placed(dealt, by, F.col("_n")), "slices")

    at = F.explode(F.arrays_zip(F.array(*map(F.lit, range(len(shares)))).alias("i"), F.array(*map(F.lit, shares)).alias("share"))).alias("s")
    spots = placed.select(*by, "slice", "before", "held", "total", at).withColumn("at", F.col("s.share") * (F.col("total") - 1))
    ranks = spots.select(*by, "slice", "before", "held", F.col("s.i").alias("i"), "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    wanted = ranks.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held"))).distinct()
    wanted = wanted.groupBy(*by, "slice", "before").agg(F.collect_set(F.struct("i", "at", "rank")).alias("wanted"))

    inside = Window.partitionBy(*by, "slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    found = _same(dealt, wanted, [*by, "slice"]).withColumn("from", F.col("before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hit = found.select(*by, "_v", F.explode(F.filter("wanted", lambda w: (w["rank"] >= F.col("from")) & (w["rank"] < F.col("from") + F.col("_n")))).alias("w"))
    ends = hit.groupBy(*by, "w.i").agg(F.min("_v").cast("double").alias("low"), F.max("_v").cast("double").alias("high"), F.first("w.at").alias("at"))
    part = F.col("at") - F.floor("at")
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), F.col("low"), F.lit(1.0) - part, F.col("high") * part).cast("double")
    each = ends.select(*by, "i", F.when(part == 0, F.col("low")).otherwise(between).alias("q"))
    exact = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
    if not by:
        return exact
    return _same(df.select(*by).distinct(), exact, by, "left")


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    equal = F.lit(True)
    for c in on:
        equal &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, equal, how).drop(*[f"_on_{c}" for c in on])


def _runs(fan: int):
    """(first, at, digest) rows to the parts of nodes that they are: first, node, start, n, and whole (the node's digest) or text (the digests of a part)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, n = None, [], 0

        def ended() -> tuple:
            text = "".join(held)
            return (*run, n, hashlib.sha256(text.encode()).hexdigest(), "") if n == fan else (*run, n, None, text)

        for batch in batches:
            out = []
            first, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "at"))
            digests = batch.column("digest").cast(pa.binary(32))
            data = memoryview(digests.buffers()[1])[32 * digests.offset :]
            node = at // fan
            cuts = np.flatnonzero((np.diff(first) != 0) | (np.diff(node) != 0) | (np.diff(at) != 1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if run is None or run[:2] != (first[a], node[a]) or run[2] + n != at[a]:
                    out += [ended()] if run is not None else []
                    run, held, n = (int(first[a]), int(node[a]), int(at[a])), [], 0
                held.append(data[32 * a : 32 * b].hex())
                n += b - a
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RUN, strict=True)] if out else [pa.array([], f.type) for f in _RUN], schema=_RUN)
        if run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(ended(), _RUN, strict=True)], schema=_RUN)

    return fold


_RUN = pa.schema([("first", pa.int64()), ("node", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("whole", pa.string()), ("text", pa.string())])


def ordered_digest(df: DataFrame, by: list[str], order: list[str | Column], line: Column, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """by, n and sha256: the top of a tree of ``levels`` levels, 1 at least, over a group's lines in order.

    A leaf is the SHA-256 (hexadecimal) of a line and a newline; a node that of the
    digests of ``fan`` successive nodes below, one after another.  Leaves move once and
    are written in order, 32 bytes each; where they are read, whole nodes are folded
    at once, and only parts of nodes that a border cuts move again.  No task holds
    more of a group than a slice of hashes and ``fan`` digests, and no row is kept.
    """
    if levels < 1:
        raise ValueError("a tree has one level at least")
    place = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    leaves = df.select(*by, place.alias("at"), F.unhex(F.sha2(F.concat(F.coalesce(line, F.lit("")), F.lit("\n")).cast("binary"), 256)).alias("digest"))
    ordered = leaves.repartitionByRange(*by, "at", "digest").sortWithinPartitions(*by, "at", "digest")
    dealt = stored(ordered.select(*by, "digest", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("row")), "leaves")  # rows of a slice count on
    firsts = dealt.groupBy(*by, "slice").agg(F.min("row").alias("first"))
    placed = stored(_same(_placed(dealt, by, F.lit(1)), firsts, [*by, "slice"]).select(*by, "slice", "before", "first"), "slices")
    numbered = _same(dealt, F.broadcast(placed), [*by, "slice"]).select("first", (F.col("before") + F.col("row") - F.col("first")).alias("at"), "digest")
    parts = numbered.mapInArrow(_runs(fan), from_arrow_schema(_RUN)).join(F.broadcast(placed.select(*by, "first")), "first")
    met = parts.groupBy(*by, F.col("node").alias("at")).agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("below"), F.sum("n").alias("n"))
    nodes = met.select(*by, "at", F.coalesce("whole", F.sha2(F.array_join(F.transform("below", lambda b: b["text"]), "").cast("binary"), 256)).alias("digest"), "n")
    for _ in range(levels - 1):
        under = nodes.groupBy(*by, F.floor(F.col("at") / fan).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("below"), F.sum("n").alias("n"))
        nodes = under.select(*by, "at", F.sha2(F.array_join(F.transform("below", lambda b: b["digest"]), "").cast("binary"), 256).alias("digest"), "n")
    return nodes.select(*by, "n", F.col("digest").alias("sha256"))

"""Rendezvous sharding of stable record keys over weighted shards [native].

Every shard bids for every key: with u a uniform number in (0, 1) from the MD5
of "key:shard", the bid is -ln(u) / weight, and the least bid wins.  A shard's
share is its weight's share.  A new shard adds bids and changes none, so the
only keys that move are those that it wins.

Slots number a shard's records by the MD5 of "key:size:crc", then by key, so
they depend on the records alone and not on partitions or on how many tasks
number them.  Records alike in key, size and CRC are counted first and numbered
as one, so neither a hot key nor repeated rows meet in one task.

Defined cases: a null key is the empty string, and comes before it; equal keys
always meet in one shard; equal bids go to the lower shard number; a weight of 0
takes nothing; null text has size 1 and CRC 0; repeated rows get a slot each; an
empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Records that one task numbers in one go; copies of one record that are made together.
SLOT_ROWS, COPIES = 20_000, 10_000


def _uniform(data: Column) -> Column:
    """52 bits of an MD5, exact in a double."""
    return F.conv(F.substring(F.md5(data.cast("binary")), 1, 13), 16, 10).cast("double")


def bid(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight; u is never 0 or 1."""
    return -F.log((_uniform(F.concat(key, F.lit(f":{shard}"))) + 0.5) / float(2**52)) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(bid, shard) of the winner for ``key``."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*bids))


def with_slots(records: DataFrame, rows_per_task: int = SLOT_ROWS) -> DataFrame:
    """Number the records of each ``shard`` from 0 without gaps, in the order of ``order`` and ``key``, without a task for a whole shard.

    ``records``: distinct, materialised rows, each standing for ``n`` records.  A
    shard is cut into as many ranges of ``order`` (an MD5) as its rows need; these
    are numbered side by side and shifted by the records in the ranges before.
    """
    sizes = records.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("long").alias("parts"))
    first = F.conv(F.substring("order", 1, 13), 16, 10).cast("double") / float(2**52)
    parts = records.join(F.broadcast(sizes), "shard").withColumn("part", F.floor(first * F.col("parts")))  # sizes: a row for each shard
    counts = parts.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "part"])
    at = placed.withColumn("slot", F.col("start") + F.col("rank")).drop("parts", "part", "rank", "start")
    lots = at.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("order", "lot")
    last = F.least(F.col("n"), (F.col("lot") + 1) * COPIES) - 1
    return lots.withColumn("slot", F.explode(F.sequence(F.col("slot") + F.col("lot") * COPIES, F.col("slot") + last))).drop("order", "lot", "n")


def shard_records(docs: DataFrame, weights: list[float], grown_weight: float | None = None, key: str = "doc_id", text: str = "text", rows_per_task: int = SLOT_ROWS) -> DataFrame:
    """key (under its name), size, text_crc32, shard, grown_shard (null without ``grown_weight``, that of one more shard) and slot."""
    most = len(weights)
    read = docs.select(F.struct("*").alias("row")).select(F.col("row")[key].alias("key"), F.coalesce(F.col("row")[text], F.lit("")).cast("binary").alias("data"))
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    won = read.select("key", (F.octet_length("data") + 1).cast("long").alias("size"), F.crc32("data").alias("text_crc32"), rendezvous(F.col("key"), weights).alias("won"))
    grown = F.lit(None).cast("int")
    if grown_weight is not None and grown_weight > 0:
        grown = F.when(bid(name, most, grown_weight) < F.col("won.bid"), F.lit(most)).otherwise(F.col("won.shard"))
    order = F.md5(F.concat_ws(":", name, "size", "text_crc32").cast("binary"))
    placed = won.select("key", "size", "text_crc32", order.alias("order"), F.col("won.shard").alias("shard"), grown.cast("int").alias("grown_shard"))
    alike = placed.groupBy(placed.columns).agg(F.count(F.lit(1)).alias("n"))
    numbered = with_slots(materialise(alike, "shards"), rows_per_task)
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard", "slot")


def moved_share(weights: list[float], grown_weight: float) -> float:
    """The share of keys that is expected to move."""
    return grown_weight / (math.fsum(weights) + grown_weight)

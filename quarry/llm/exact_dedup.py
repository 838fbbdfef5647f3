"""Exact deduplication [native]: an extendible-hash index on shared files, owner tasks over key ranges, bytes compared along chains.

Texts are equal when their bytes are; a null text is an empty one.  Every row is a document.

1. Keys.  One pass gives every text a key of 64 bits; rows are folded to one entry a
   key (rows and bytes), which are written to the shared folder.
2. Directory.  Its slots are the first bits of a key.  A bucket starts with all keys;
   while it holds more than its capacity, the directory doubles and the bucket splits
   by one more bit.  The loads of all prefixes of up to ``SLOT_BITS`` bits come from one
   job, so a bucket is a prefix that fits and whose parent does not.  A bucket that is
   overfull at the last doubling gets overflow parts by further bits of the key; the
   last one is ``SPARE_BITS`` beyond what buckets of equal loads would take, since a few
   neighbours with large loads would double the whole directory for themselves.
   Keys with more bytes than a capacity cannot be split by bits: they are taken out of
   the loads and get a chain of overflow parts each, to which input splits are dealt.
   The directory (slot, bucket, parts) is written to the shared folder.
3. Owners.  Rows look up their bucket and move once, to the task that owns it.  There
   rows stream in the order of key and text: rows of one key are a chain, whose texts
   are told apart by their bytes, and of equal texts the one with the largest id is first.
4. Chains in several parts: the parts' counts and first ids meet, a row a part and text.

The capacity is ``BUCKET_BYTES``, or what leaves at most 2 ** (SLOT_BITS - 1) buckets
if that is more; the directory has at most 2 ** SLOT_BITS rows, and keys with chains of
their own are at most ``HOT_KEYS``: both are broadcast.

Defined cases: of rows with equal text and equal id exactly one stays; a null id is
smaller than all others; other columns, of any name, stay in ``row``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Most doublings of the directory, bytes that a bucket holds at least before it splits, and most keys with a chain of their own.
SLOT_BITS, BUCKET_BYTES, HOT_KEYS = 20, 256 << 10, 100_000
#: Doublings beyond those of buckets with equal loads.
SPARE_BITS = 2
#: Bytes that a row counts besides its text.
ROW_BYTES = 64
#: Most (key, text) totals of split chains that are broadcast; keys of 64 bits hold hardly more than one text each.
TOTALS = 1_000_000


def keys_of(docs: DataFrame, text: str = "text", key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """key, n_rows and n_bytes of every key, written once to the shared folder."""
    filled = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(key(filled).alias("key"), (F.octet_length(filled) + F.lit(ROW_BYTES)).cast("long").alias("size"))
    return materialise(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")), "keys")


def split_buckets(loads: DataFrame, capacity: int, bits: int = SLOT_BITS) -> DataFrame:
    """depth, prefix, load of the buckets; ``loads``: slot (of ``bits`` bits) and load."""
    at = loads.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = at.groupBy("depth", F.expr(f"shiftright(slot, {bits} - depth)").alias("prefix")).agg(F.sum("load").alias("load"))
    above = nodes.where(F.col("load") > capacity).select((F.col("depth") + 1).alias("_depth"), F.col("prefix").alias("_prefix"))
    under = nodes.join(above, (F.col("depth") == F.col("_depth")) & (F.shiftright("prefix", 1) == F.col("_prefix")), "left")
    fits = (F.col("load") <= capacity) | (F.col("depth") == bits)
    return under.where(fits & ((F.col("depth") == 0) | F.col("_depth").isNotNull())).select("depth", "prefix", "load")


def directory_of(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, bits: int = SLOT_BITS, hot_keys: int = HOT_KEYS) -> tuple[DataFrame, DataFrame, int]:
    """The directory (slot, bucket, overflow), the split chains (hot_key, parts) and the directory's bits."""
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = max(bucket_bytes, total >> (bits - 1))
    bits = min(bits, (total // capacity).bit_length() + SPARE_BITS)
    alone = F.col("n_bytes") > max(capacity, total // hot_keys)
    parts = lambda load: F.ceil(load / F.lit(capacity)).cast("int")
    chains = materialise(keys.where(alone).select(F.col("key").alias("hot_key"), parts(F.col("n_bytes")).alias("parts")), "chains")
    loads = keys.where(~alone).groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.sum("n_bytes").alias("load"))
    buckets = materialise(split_buckets(loads, capacity, bits), "buckets")
    depth = max(1, buckets.agg(F.max("depth")).first()[0] or 0)
    first, width = F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(1L, {depth} - depth)")
    doubled = buckets.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), F.expr(f"shiftleft(prefix, {bits} - depth)").alias("bucket"), F.greatest(F.lit(1), parts(F.col("load"))).alias("overflow"))
    return materialise(doubled, "directory"), chains, depth


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Callable[[Column], Column] = F.xxhash64, bucket_bytes: int = BUCKET_BYTES, bits: int = SLOT_BITS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """row (all columns of ``docs``), keep_id, group_size, kept and text_sha256 for every row; ``key`` may collide, it only costs time."""
    directory, chains, depth = directory_of(keys_of(docs, text, key), bucket_bytes, bits, hot_keys)
    filled, others = F.coalesce(F.col(text), F.lit("")), [c for c in docs.columns if c != text]
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(F.struct(*map(column, others)).alias("others"), column(doc_id).alias("id"), filled.alias("filled"), F.col(text).isNull().alias("was_null"), key(filled).alias("key"))
    found = rows.join(F.broadcast(chains), F.col("key") == F.col("hot_key"), "left")
    back = F.struct(*[F.col("others")[c].alias(c) if c != text else F.when(~F.col("was_null"), F.col("filled")).alias(c) for c in docs.columns]).alias("row")

    cold = found.where("parts IS NULL").withColumn("at", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(directory), F.col("at") == F.col("slot"))
    owned = _owned(cold.select(*rows.columns, "bucket", F.pmod(F.xxhash64("key"), F.col("overflow")).alias("part")))
    result = owned.select(back, F.col("top").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    if chains.isEmpty():
        return result

    hot = found.where("parts IS NOT NULL").select(*rows.columns, F.shiftrightunsigned("key", 64 - bits).alias("bucket"), F.pmod(F.spark_partition_id(), F.col("parts")).cast("long").alias("part"))
    split = materialise(_owned(hot), "split-chains")
    totals = split.where("place = 1").groupBy(F.col("key").alias("_key"), F.col("text_sha256").alias("_sha256")).agg(F.sum("n").alias("group_size"), F.max(F.struct("top", "part")).alias("best"))
    totals = materialise(totals, "chain-totals")
    if totals.count() <= TOTALS:
        totals = F.broadcast(totals)
    joined = split.join(totals, (F.col("key") == F.col("_key")) & (F.col("text_sha256") == F.col("_sha256")))
    first = (F.col("place") == 1) & (F.col("part") == F.col("best.part"))
    return result.unionByName(joined.select(back, F.col("best.top").alias("keep_id"), "group_size", first.alias("kept"), "text_sha256"))


def _owned(routed: DataFrame) -> DataFrame:
    """The columns of ``routed`` but its bucket, and of each row's text in its part: n rows, the largest id as top, and the row's place."""
    equal = Window.partitionBy("bucket", "part", "key", "filled").orderBy(F.col("id").desc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = routed.repartition("bucket", "part")
    chained = dealt.withColumns({"n": F.count(F.lit(1)).over(whole), "top": F.first("id").over(whole), "place": F.row_number().over(equal)})
    return chained.drop("bucket", "id").withColumn("text_sha256", F.sha2(F.col("filled").cast("binary"), 256))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that stay."""
    return dedup(docs, doc_id, text).where("kept").select("row.*")

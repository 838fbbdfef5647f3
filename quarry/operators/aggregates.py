"""Aggregates of evidence: histograms, ranges, functional dependence, extremes with ties, ordered hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def histogram(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, value and n: a row for each bar."""
    return df.groupBy(*by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(bars: DataFrame, by: list[str]) -> DataFrame:
    """The bars of a histogram as one map in order of values; the number of distinct values must be bounded."""
    return bars.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("histogram"))


def arg_min(row: Column, value: Column, ordinal: Column) -> Column:
    """The row with the least value, the first on ties."""
    return F.min_by(row, F.struct(value, ordinal))


def arg_max(row: Column, value: Column, ordinal: Column) -> Column:
    """The row with the largest value, the first on ties."""
    return F.max_by(row, F.struct(value, -ordinal))


def dependence(df: DataFrame, a: str, b: str) -> DataFrame:
    """For both directions: how many values determine, and whether each has one value of the other."""
    pairs = df.select(a, b).distinct()
    one = lambda k, v: pairs.groupBy(k).agg(F.count(F.lit(1)).alias("_n")).agg(F.lit(f"{k}->{v}").alias("direction"), F.count(F.lit(1)).alias("n_values"), (F.max("_n") == 1).alias("determines"))
    return one(a, b).unionByName(one(b, a))


def exact_quantiles(value: Column, shares: list[float]) -> Column:
    return F.percentile(value, F.array(*map(F.lit, shares)))


def ordered_sha256(line: Column, *order: Column) -> Column:
    """SHA-256 of a group's lines in order, each with a newline; a group's lines must fit in memory."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return F.sha2(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).cast("binary"), 256)


def counters(by_name: dict[str, Column]) -> list[Column]:
    """count_if of each named condition."""
    return [F.count_if(c).alias(n) for n, c in by_name.items()]


def grains(df: DataFrame, levels: list[str], **aggregates: Column) -> DataFrame:
    """The aggregates at every prefix of ``levels``, with ``grain``: how many levels the row has."""
    return df.rollup(*levels).agg((F.lit(len(levels)) - sum((F.grouping(c) for c in levels), F.lit(0))).cast("int").alias("grain"), *[a.alias(n) for n, a in aggregates.items()])


def byte_entropy(df: DataFrame, by: list[str], data: Column) -> DataFrame:
    """by, bytes and the entropy in bits of a byte: 256 counters of each group are summed up within a batch before anything is shuffled."""
    rows = df.select(F.struct(*by).alias("by"), data.cast("binary").alias("data"))
    schema = T.StructType([rows.schema["by"], T.StructField("counts", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, np.ndarray] = {}
            for key, one in zip(batch.column("by").to_pylist(), batch.column("data"), strict=True):
                own = held.setdefault(tuple(key.values()), np.zeros(256, np.int64))
                if one.is_valid:
                    own += np.bincount(np.frombuffer(one.as_buffer(), np.uint8), minlength=256)
            keys = pa.array([dict(zip(by, k, strict=True)) for k in held], batch.schema.field("by").type)
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(list, held.values()), pa.list_(pa.int64()))], names=["by", "counts"])

    found = rows.mapInArrow(count, schema).select("by.*", F.posexplode("counts").alias("byte", "n")).groupBy(*by, "byte").agg(F.sum("n").alias("n"))
    size, seen = F.sum("n"), F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n").cast("double"))).otherwise(0.0)
    return found.groupBy(*by).agg(size.alias("bytes"), F.when(size > 0, F.log2(size.cast("double")) - F.sum(seen) / size).alias("entropy"))

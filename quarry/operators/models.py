"""Fitted and fixed hypotheses over measured rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def affine_fit(df: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """by, coefficients (intercept first) and rows: least squares for each group.

    Only the sums of the normal equations are gathered, a row for each group, about
    the means of all rows, so that large offsets cost no digits, and solved in
    centred and scaled form; a group of too low rank has null coefficients.
    """
    names = [*features, target]
    products = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    centre = np.array([means[c] or 0.0 for c in names])
    value = lambda n: F.col(n).cast("double") - F.lit(float(centre[names.index(n)]))
    moments = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(value(c)) for c in names]).alias("s"), F.array(*[F.sum(value(names[i]) * value(names[j])) for i, j in products]).alias("p"))
    k = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for group, n, s, p in zip(pdf[by], pdf["n"], pdf["s"], pdf["p"], strict=True):
                s = np.asarray(s, float)
                full = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(products, p, strict=True):
                    full[i, j] = full[j, i] = v - s[i] * s[j] / n
                scale = np.sqrt(np.maximum(np.diag(full)[:k], 0))
                if (scale <= 0).any() or np.linalg.matrix_rank(full[:k, :k] / np.outer(scale, scale)) < k:
                    out.append((group, None, n))
                    continue
                slope = np.linalg.solve(full[:k, :k] / np.outer(scale, scale), full[:k, k] / scale) / scale
                intercept = (s[k] - slope @ s[:k]) / n + centre[k] - slope @ centre[:k]
                out.append((group, [float(intercept), *map(float, slope)], n))
            yield pd.DataFrame(out, columns=[by, "coefficients", "rows"])

    return moments.mapInPandas(solve, f"{by} {dict(df.dtypes)[by]}, coefficients array<double>, rows long")


def hypotheses(df: DataFrame, by: list[str], predictions: dict[str, Column], actual: Column, tolerance: float) -> DataFrame:
    """by, hypothesis, rows, matches and max_error: every prediction against every row in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("hypothesis"), F.abs(p - actual).alias("error")) for n, p in predictions.items()]))
    return df.select(*by, each.alias("h")).groupBy(*by, F.col("h.hypothesis").alias("hypothesis")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("h.error") <= tolerance).alias("matches"), F.max("h.error").alias("max_error"))


def mutation_outcome(baseline: DataFrame, mutant: DataFrame, on: list[str], identity: str, position: list[str]) -> DataFrame:
    """Before and after of each drawn thing: COUNT_CHANGED, IDENTICAL, STREAM_ONLY, TRANSLATION or OTHER, folded to one row."""
    a, b = baseline.select(*on, F.struct(identity, *position).alias("a")), mutant.select(*on, F.struct(identity, *position).alias("b"))
    both = a.join(b, on, "full_outer")
    moved = ~F.struct(*[F.col(f"a.{p}") for p in position]).eqNullSafe(F.struct(*[F.col(f"b.{p}") for p in position]))
    other = ~F.col(f"a.{identity}").eqNullSafe(F.col(f"b.{identity}"))
    found = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.count_if(moved).alias("moved"), F.count_if(other).alias("changed"))
    return found.withColumn("outcome", F.when(F.col("unpaired") > 0, "COUNT_CHANGED").when((F.col("moved") == 0) & (F.col("changed") == 0), "IDENTICAL").when(F.col("moved") == 0, "STREAM_ONLY").when(F.col("changed") == 0, "TRANSLATION").otherwise("OTHER"))

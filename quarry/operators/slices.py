"""Slices of a table's order whose borders are known beforehand, so that rows are dealt once and nothing is written to learn where they went.

``borders`` takes keys from a sample, and only decides how large slices are; every
row finds its slice by bisection.  A key that many rows share is cut too if something
that tells them apart ends it.

Defined cases: an empty table and one of few rows have no border and one slice;
nulls come first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a slice has on average, and the most borders: beyond them slices grow.
SLICE_ROWS, MOST = 250_000, (1 << 12) - 1
#: Sampled keys a border.
SAMPLED = 16


def borders(keys: DataFrame, slice_rows: int | None = None) -> tuple[Column, int]:
    """The borders of ``keys`` (one column, a struct) in order as an array, and their number."""
    (name,) = keys.columns
    rows = keys.count()
    n = min(MOST, rows // (slice_rows or SLICE_ROWS))
    sample = keys.sample(min(1.0, SAMPLED * n / rows), 1).orderBy(name).select(F.to_json(name)).collect() if n else []
    n = min(n, len(sample))
    text = ",".join(sample[(i + 1) * len(sample) // (n + 1)][0] for i in range(n))
    return F.sort_array(F.from_json(F.lit(f"[{text}]"), T.ArrayType(keys.schema[name].dataType))), n  # sorted whatever JSON makes of a type


def slice_of(cut: tuple[Column, int], key: Column) -> Column:
    """How many borders are not above ``key``."""
    found, n = cut
    if not n:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(math.floor(math.log2(n)) + 1))]
    state = lambda key, at: F.struct(key.alias("key"), at.alias("at"))
    further = lambda s, step: state(s["key"], F.when(F.get(found, s["at"] + step - 1) <= s["key"], s["at"] + step).otherwise(s["at"]))
    return F.aggregate(F.array(*map(F.lit, steps)), state(key, F.lit(0)), further, lambda s: s["at"])  # a key is computed once

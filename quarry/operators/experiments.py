"""Controlled experiments: predictions on rows kept apart, planned mutations, byte edits with proof, and what data leave open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.rasters import byte_at, from_byte
from quarry.operators.sequences import positions_differing


def predicted(coefficients: Column, features: list[Column]) -> Column:
    """Of an affine fit, the intercept first; null for a fit without coefficients."""
    return sum((coefficients[i + 1] * f for i, f in enumerate(features)), coefficients[0])


def evaluated(df: DataFrame, by: list[str], train: Column, hypotheses: dict[str, Column], actual: Column, tolerance: float, key: str, examples: int = 5) -> DataFrame:
    """by, role (TRAIN or VALIDATE), hypothesis, rows, matches, max_error and the smallest ``key`` of rows that do not match, ``examples`` at most (a report's limit)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("hypothesis"), F.abs(p - actual).alias("error")) for n, p in hypotheses.items()]))
    rows = df.select(*by, F.when(train, "TRAIN").otherwise("VALIDATE").alias("role"), F.col(key).alias("_key"), each.alias("h")).select(*by, "role", "_key", "h.*")
    group = [*by, "role", "hypothesis"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error") <= tolerance).alias("matches"), F.max("error").alias("max_error"))
    wrong = rows.where((F.col("error") > tolerance) | F.col("error").isNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_key"))).where(F.col("_n") <= examples)
    shown = wrong.groupBy(*group).agg(F.array_sort(F.collect_list("_key")).alias("counterexamples"))
    return counts.join(shown, group, "left").withColumn("counterexamples", F.coalesce("counterexamples", F.array().cast(shown.schema["counterexamples"].dataType)))


def planned(df: DataFrame, keys: list[str], fields: dict[str, tuple[Column, int]], size: Column) -> DataFrame:
    """keys, field, at and width of every byte field (place and width in bytes) that lies within ``size``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), at.cast("long").alias("at"), F.lit(w).alias("width")) for n, (at, w) in fields.items()]))
    return df.select(*keys, size.alias("_size"), each.alias("f")).where((F.col("f.at") >= 0) & (F.col("f.at") + F.col("f.width") <= F.col("_size"))).select(*keys, "f.*")


def overlaid(data: Column, patch: Column, at: Column) -> Column:
    """``data`` with ``patch`` over it from a place (from 0); null where it does not fit."""
    size = F.octet_length(patch)
    fits = (at >= 0) & (at + size <= F.octet_length(data))
    return F.when(fits, F.concat(F.substring(data, F.lit(1), at), patch, F.substring(data, at + size + 1, F.octet_length(data))))


def lowest_bit_flipped(data: Column, at: Column) -> Column:
    """``data`` with the lowest bit of the little-endian field at ``at`` turned; null outside."""
    return F.when((at >= 0) & (at < F.octet_length(data)), overlaid(data, from_byte(byte_at(data, at).bitwiseXOR(F.lit(1))), at))


def changed_once(before: Column, after: Column, at: Column) -> Column:
    """Whether the byte at ``at`` and no other differs."""
    found = positions_differing(before, after)
    return (F.size(found) == 1) & (F.get(found, F.lit(0)) == at)


def transplanted(target: Column, donor: Column, at: Column, width: Column) -> Column:
    """``target`` with the donor's component of the same place and width; null where either lacks it."""
    return F.when((at >= 0) & (at + width <= F.octet_length(donor)), overlaid(target, F.substring(donor, at + 1, width), at))


def content_replaced(data: Column, content: Column, at: Column, declared_sha256: Column) -> Column:
    """``data`` with ``content`` in place of what was declared by its hash before; null where something else is there."""
    here = F.substring(data, at + 1, F.octet_length(content))
    return F.when(F.sha2(here, 256) == declared_sha256, overlaid(data, content, at))


def geometry_outcome(before: DataFrame, after: DataFrame, on: list[str], place: list[str], size: list[str], position: list[str]) -> DataFrame:
    """on, n and outcome, from the drawings of both: PAGE_OR_DRAW_COUNT_CHANGED, else IMAGE_DIMENSIONS_CHANGED, else NO_GEOMETRY_CHANGE, else EXTRA_IMAGE_TRANSLATION_CHANGED where only positions changed and not of the first drawing, else OTHER_GEOMETRY_CHANGE."""
    side = lambda df, name: df.select(*on, *place, F.struct(*size).alias(f"{name}_size"), F.struct(*position).alias(f"{name}_position"))
    both = side(before, "a").join(side(after, "b"), [*on, *place], "full_outer")
    lacks = F.col("a_size").isNull() | F.col("b_size").isNull()
    resized, moved = ~F.col("a_size").eqNullSafe(F.col("b_size")), ~F.col("a_position").eqNullSafe(F.col("b_position"))
    found = both.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count_if(lacks).alias("lacking"), F.count_if(resized & ~lacks).alias("resized"), F.count_if(moved & ~lacks).alias("moved"), F.count_if(moved & ~lacks & (F.col(place[-1]) == 0)).alias("first_moved"))
    outcome = (
        F.when(F.col("lacking") > 0, "PAGE_OR_DRAW_COUNT_CHANGED").when(F.col("resized") > 0, "IMAGE_DIMENSIONS_CHANGED").when(F.col("moved") == 0, "NO_GEOMETRY_CHANGE")
        .when(F.col("first_moved") == 0, "EXTRA_IMAGE_TRANSLATION_CHANGED").otherwise("OTHER_GEOMETRY_CHANGE")
    )
    return found.select(*on, "n", outcome.alias("outcome"))


def completions(palette: Column, indices: Column, entry_bytes: int = 3, entries: int = 256) -> Column:
    """Of an image whose palette was cut short: entries left, indices beyond them, and the hashes of two renderings that keep all that is left, filled with 00 and with FF.

    Where an index points beyond, the renderings differ: what is missing is not determined by what is left.
    """
    left = (F.octet_length(palette) / entry_bytes).cast("int")
    drawn = lambda fill: F.transform(indices, lambda i: F.when(i < left, F.hex(F.substring(palette, i * entry_bytes + 1, F.lit(entry_bytes)))).otherwise(fill * entry_bytes))
    sha = lambda fill: F.sha2(F.array_join(drawn(fill), "").cast("binary"), 256)
    beyond = F.size(F.filter(indices, lambda i: (i >= left) & (i < entries)))
    return F.struct(left.alias("entries"), beyond.alias("beyond"), sha("00").alias("low_sha256"), sha("FF").alias("high_sha256"), (sha("00") != sha("FF")).alias("undetermined"))

"""Proofs over references: chains to their ends, paths and owners of a value, lineage, lookups with one answer, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stored import stored


def resolved(references: DataFrame, most: int = 16) -> DataFrame:
    """(node, target, steps, status) of references given as (node, next): RESOLVED with the node that refers to none, or REFUSED for cycles, chains of more than ``most`` steps and ends that are no node.

    Pointers are doubled, so the rounds are the logarithm of ``most``.
    """
    state = references.select("node", F.coalesce("next", "node").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("steps"), F.col("next").isNull().alias("ended"))
    state = stored(state, "chains")
    reach = 1
    while reach <= most:
        further = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"), F.col("ended").alias("far_ended"))
        joined = state.join(further, "at", "left")
        state = stored(joined.select("node", F.coalesce("far", "at").alias("at"), (F.col("steps") + F.when(F.col("ended"), 0).otherwise(F.coalesce("more", F.lit(0)))).alias("steps"), F.coalesce(F.col("ended") | F.col("far_ended"), F.lit(False)).alias("ended")), "chains")
        reach *= 2
    good = F.col("ended") & (F.col("steps") <= most)
    return state.select("node", F.when(good, F.col("at")).alias("target"), F.when(good, F.col("steps")).alias("steps"), F.when(good, "RESOLVED").otherwise("REFUSED").alias("status"))


def paths_to(leaves: DataFrame, owner: str, target: Column) -> DataFrame:
    """owner and the sorted paths at which its nested document, given as (owner, path, value) rows, holds ``target``."""
    return leaves.where(F.col("value") == target).groupBy(owner).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def owners_differ(found: DataFrame, expected: DataFrame, owner: str) -> DataFrame:
    """Owners whose paths are not those expected, or that only one side has."""
    a, b = found.select(owner, F.col("paths").alias("found")), expected.select(owner, F.col("paths").alias("expected"))
    return a.join(b, owner, "full_outer").where(~F.col("found").eqNullSafe(F.col("expected")))


def lineage(receipts: DataFrame, key: str, links: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """key, status and the names of links that lead nowhere: each link is a column of the receipt and the table of identities it must be in; a null link is missing."""
    out = receipts
    for name, (column, known) in links.items():
        found = known.select(F.col(known.columns[0]).alias(f"_{name}")).distinct().withColumn(f"_has_{name}", F.lit(True))
        out = out.join(found, F.col(column) == F.col(f"_{name}"), "left")
    missing = F.filter(F.array(*[F.when(F.col(f"_has_{n}").isNull(), n) for n in links]), lambda x: x.isNotNull())
    return out.select(key, F.when(F.size(missing) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(missing, ",").alias("missing"))


def only_candidate(rows: DataFrame, candidates: DataFrame, on: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` where the key has exactly one distinct candidate, and how many it has."""
    one = candidates.groupBy(*on).agg(F.count_distinct(value).alias("candidates"), F.min(value).alias("_value"))
    return rows.join(one, on, "left").withColumns({"candidates": F.coalesce("candidates", F.lit(0).cast("long")), value: F.when(F.col("candidates") == 1, F.col("_value"))}).drop("_value")


def dispatched(rows: DataFrame, kind: str, own: Column, direct: list[int], looked_up: list[int], candidates: DataFrame, on: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` and status: records of the kinds ``direct`` have their own value, those of ``looked_up`` that of the one candidate of their key; MISSING, AMBIGUOUS (two distinct candidates or more) and UNSUPPORTED (another kind, or null) have none.

    Only the rows that are looked up are joined.
    """
    columns, of = [*rows.columns, value, "status"], F.col(kind)
    none = F.lit(None).cast(candidates.schema[value].dataType)
    has_own = rows.where(of.isin(direct)).withColumn(value, own.cast(candidates.schema[value].dataType))
    has_own = has_own.withColumn("status", F.when(F.col(value).isNull(), "MISSING").otherwise("PASS"))
    found = only_candidate(rows.where(of.isin(looked_up)), candidates, on, value)
    found = found.withColumn("status", F.when(F.col("candidates") == 0, "MISSING").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("PASS"))
    others = rows.where(of.isNull() | ~of.isin([*direct, *looked_up])).withColumns({value: none, "status": F.lit("UNSUPPORTED")})
    return has_own.select(*columns).unionByName(found.select(*columns)).unionByName(others.select(*columns))


def latest_since(events: DataFrame, on: list[str], order: str, least: Column, columns: list[str]) -> DataFrame:
    """on and ``columns`` of each key's last event that is not before ``least``."""
    return events.where(F.col(order) >= least).groupBy(*on).agg(F.max_by(F.struct(*columns), order).alias("_e")).select(*on, "_e.*")


def alignment(left: DataFrame, right: DataFrame, on: list[str], ordinal: str, fields: list[str]) -> DataFrame:
    """on, compared, unpaired and how many positions agree in each of ``fields``."""
    a, b = left.select(*on, ordinal, F.struct(*fields).alias("a")), right.select(*on, ordinal, F.struct(*fields).alias("b"))
    both = a.join(b, [*on, ordinal], "full_outer")
    return both.groupBy(*on).agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), *[F.count_if(F.col(f"a.{f}") == F.col(f"b.{f}")).alias(f"same_{f}") for f in fields])


def contained(path: Column) -> Column:
    """Whether a relative path, segment by segment, never leaves its root."""
    steps = F.transform(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), lambda s: F.when(s == "..", -1).otherwise(1))
    lowest = F.aggregate(steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")), lambda a, s: F.struct((a["depth"] + s).alias("depth"), F.least(a["lowest"], a["depth"] + s).alias("lowest")))
    return ~F.startswith(path, F.lit("/")) & (lowest["lowest"] >= 0)


def matches_template(text: Column, template: str, values: dict[str, Column]) -> Column:
    """Whether ``text`` is the template with its ``{name}`` filled in."""
    filled = F.lit(template)
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return text == filled


def route(requested: Column, pages: Column) -> Column:
    """The pages to visit: those requested if they are distinct and in range, all if none are requested, else null."""
    every = F.sequence(F.lit(1).cast("long"), F.greatest(pages, F.lit(1)).cast("long"))
    good = (F.size(F.array_distinct(requested)) == F.size(requested)) & F.forall(requested, lambda p: (p >= 1) & (p <= pages))
    return F.when(pages < 1, None).when(requested.isNull() | (F.size(requested) == 0), every).when(good, requested.cast("array<bigint>"))


def without(value: Column, kind: T.DataType, names: set[str]) -> Column:
    """A nested value without the fields of these names, at any depth."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*[without(value[f.name], f.dataType, names).alias(f.name) for f in kept]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: without(v, kind.elementType, names))
    return value


def summary_of(items: Column, fields: list[str]) -> Column:
    """Items by ordinal, from 1, with none but ``fields``: what identifies them goes."""
    return F.transform(items, lambda item, i: F.struct((i + 1).alias("ordinal"), *[item[f].alias(f) for f in fields]))


def same_order(rows: DataFrame, by: list[str], side: str, order: list[str], value: str, places: list[int] | None = None) -> DataFrame:
    """by and same: whether the values of side 0 and side 1 are the same in the same order; of side 0 only those at ``places`` (from 1), if given."""
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col(side) == s, F.struct(*order, value)))), lambda r: r[value])
    found = rows.groupBy(*by).agg(listed(0).alias("_left"), listed(1).alias("_right"))
    left = F.col("_left") if places is None else F.array(*[F.get("_left", F.lit(p - 1)) for p in places])
    return found.select(*by, F.coalesce(left == F.col("_right"), F.lit(False)).alias("same"))

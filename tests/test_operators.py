"""Operators on small rows: the cases that tables of a benchmark do not have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import joins as J
from quarry.operators import models as M
from quarry.operators import rules as R
from quarry.operators import sequences as S
from quarry.operators import status as ST
from quarry.operators import trees as TR


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_status_algebra(spark):
    fold = lambda rows: spark.createDataFrame([(r,) for r in rows], "s string").agg(ST.fold(F.col("s")).alias("f")).first()["f"]
    assert fold(["PASS", "NOT_RUN"]) == "NOT_RUN" and fold(["PASS", "FAIL", "NOT_RUN"]) == "FAIL" and fold([]) == "NOT_RUN" and fold(["PASS", "odd"]) is None
    assert value(spark, ST.verdict(F.lit(False), F.lit(True))) == "NOT_RUN" and value(spark, ST.verdict(F.lit(True), F.lit(None).cast("boolean"))) == "NOT_RUN" and value(spark, ST.verdict(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))) == "FAIL"


def test_rules_guard_and_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, -1), (3, "a", -1)], "id int, name string, n int")
    rules = [R.Rule("named", F.col("name").isNotNull(), guard=True), R.Rule("positive", F.col("n") > 0)]
    assert sorted((r["id"], r["rule"]) for r in R.violations(df, ["id"], rules).collect()) == [(2, "named"), (3, "positive")]
    assert [r["id"] for r in R.later_duplicates(df, ["name"], ["id"]).collect()] == [3]
    paths = ["a/b", "/a", "a/../b", "a//b", "c:x", "a\\b", "", "a/."]
    assert [value(spark, R.relative_path(F.lit(p))) for p in paths] == [True] + [False] * 7
    assert value(spark, R.allowed_changes(F.array(F.lit("Parent")), ["Parent"])) and not value(spark, R.allowed_changes(F.array(F.lit("x")), []))


def test_as_of_ties_tolerance_and_no_partner(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int").withColumn("id", F.col("t"))
    right = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 12, 3)], "k int, t int, id int")
    got = {(r["a"]["k"], r["a"]["t"]): r["b"] and r["b"]["id"] for r in J.as_of(left, right, ["k"], "t", "id", F.lit(5)).collect()}
    assert got == {(1, 10): 2, (1, 20): None, (2, 5): None}


def test_temporal_pairs_with_and_without_bins(spark):
    rows = spark.sql("SELECT id % 3 AS k, timestamp_seconds(id * 7) AS t, id FROM range(60)")
    plain = J.temporal_pairs(rows, rows, ["k"], "t", F.expr("INTERVAL 60 SECONDS"))
    binned = J.temporal_pairs(rows, rows, ["k"], "t", F.expr("INTERVAL 60 SECONDS"), width=60)
    pairs = lambda df: sorted((r["a"]["id"], r["b"]["id"]) for r in df.collect())
    assert pairs(plain) == pairs(binned) and len(pairs(plain)) > 100


def test_diff_with_nulls(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 1)], "k int, s string, n int")
    assert {r["k"]: (r["change"], r["columns"]) for r in J.full_outer_diff(a, b, ["k"], ["s", "n"]).collect()} == {1: ("SAME", []), 2: ("CHANGED", ["n"]), 3: ("MISSING", []), 4: ("ADDED", [])}


def test_sequences(spark):
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")
    assert value(spark, S.cyclic_match(arr(1, 2, 1, 2), arr(1, 2))) and not value(spark, S.cyclic_match(arr(1, 2, 1), arr(1, 2))) and value(spark, S.cyclic_match(arr(), arr())) and not value(spark, S.cyclic_match(arr(1), arr()))
    assert [value(spark, S.first_difference(a, b)) for a, b in ((arr(1, 2), arr(1, 3)), (arr(1), arr(1, 2)), (arr(1, 2), arr(1, 2)), (arr(), arr(1)))] == [1, 1, None, 0]
    assert [value(spark, S.newer(F.lit(a).cast("long"), F.lit(b).cast("long"))) for a, b in ((1, 0), (0, 1), (0, 4294967295), (5, 5))] == [True, False, True, False]
    assert value(spark, S.positions_differing(F.lit(b"abcd"), F.lit(b"aXcY"))) == [1, 3]
    runs = S.islands(spark.createDataFrame([(1,), (2,), (2,), (5,)], "p int").withColumn("g", F.lit(0)), ["g"], "p")
    assert sorted((r["start"], r["length"]) for r in runs.collect()) == [(1, 2), (5, 1)]
    reset = spark.createDataFrame([(1, "v", 5), (2, "r", None), (3, "x", None), (4, "v", 7)], "t int, op string, v int").withColumn("k", F.lit(0))
    got = S.resettable(reset, ["k"], ["t"], {"state": F.col("v")}, F.col("op") == "r").orderBy("t").collect()
    assert [r["state"] for r in got] == [5, None, None, 7]
    gaps = S.sweep(spark.createDataFrame([(0, 5), (3, 4), (7, 9)], "a int, b int").withColumn("k", F.lit(0)), ["k"], "a", "b", []).orderBy("a").collect()
    assert [r["gap"] for r in gaps] == [None, -2, 2]
    assert S.tiles(spark.createDataFrame([(0, 4), (5, 9), (11, 12)], "a int, b int").withColumn("k", F.lit(0)), ["k"], "a", "b").count() == 1


def test_running_state_of_a_hot_key_equals_one_window(spark, monkeypatch):
    import random

    from quarry.operators import running as RU

    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice(["r", "v", "x", "o"]), rng.choice([None, rng.randint(0, 9)])) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, op string, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def every():
        opens, v = F.col("op") == "o", F.when(F.col("op") == "v", F.col("v"))
        left, right = df.where("op = 'x'"), df.where("op = 'v'")
        found = [
            J.lifetimes(df, ["k"], ["t"], opens), J.live_count(df, ["k"], ["t"], F.when(opens, 1).otherwise(-1)), S.carry_forward(df, ["k"], ["t"], {"last": v, "other": F.when(opens, F.col("t"))}),
            S.resettable(df, ["k"], ["t"], {"last": v}, F.col("op") == "r"), S.sweep(df.withColumn("e", F.col("t") + F.coalesce("v", F.lit(0)) * 3), ["k"], "t", "e", []), J.as_of(left, right, ["k"], "t", "t", F.lit(40)),
        ]
        return [sorted(map(str, one.collect())) for one in found]

    plain = every()
    monkeypatch.setattr(RU, "HOT_ROWS", 0)
    try:
        assert every() == plain
        assert RU.running(df.limit(0), ["k"], ["t"], sums={"s": F.col("v")}).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_descendants_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(0, 1000 + i) for i in range(50)] + [(500, 501)]
    got = {r["ancestor"]: r["n_descendants"] for r in TR.descendant_counts(spark.createDataFrame(edges, "parent int, node int")).collect()}
    assert got == {0: 90, **{i: 40 - i for i in range(1, 40)}, 500: 1}
    for cycle in ([(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError):
            TR.descendant_counts(spark.createDataFrame(cycle, "parent int, node int"))


def test_entropy_of_nulls_and_uniform_bytes(spark):
    df = spark.createDataFrame([("a", bytes(range(256))), ("a", bytes(range(256))), ("b", b"xxxx"), (None, b"xy"), ("c", None)], "g string, d binary")
    assert {r["g"]: (r["bytes"], r["entropy"]) for r in A.byte_entropy(df, ["g"], F.col("d")).collect()} == {"a": (512, 8.0), "b": (4, 0.0), None: (2, 1.0), "c": (0, None)}


def test_trees_refuse_cycles_and_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "parent int, node int")
    assert TR.ancestors(chain).count() == 210
    with pytest.raises(ValueError):
        TR.ancestors(chain, depth=8)
    with pytest.raises(ValueError):
        TR.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "parent int, node int"))
    assert TR.ancestors(chain.limit(0)).count() == 0
    siblings = spark.createDataFrame([(1, None, 2), (2, 1, 3), (3, 9, None)], "node int, previous int, next int")
    assert {r["node"]: r["status"] for r in TR.backlinks(siblings).collect()} == {1: "PASS", 2: "FAIL", 3: "PASS"}


def test_affine_fit_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 4 + x @ [1.5, -2, 0.25]
    df = spark.createDataFrame([(i % 2, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [(9, 1.0, 1.0, 1.0, 2.0)], "g int, a double, b double, c double, y double")
    got = {r["g"]: r["coefficients"] for r in M.affine_fit(df, "g", ["a", "b", "c"], "y").collect()}
    assert np.allclose(got[0], [4, 1.5, -2, 0.25]) and np.allclose(got[1], [4, 1.5, -2, 0.25]) and got[9] is None


def test_affine_fit_far_from_zero(spark):
    rows = [(0, 1e9 + i, 3e9 + 2 * i + (i % 2)) for i in range(50)]
    got = M.affine_fit(spark.createDataFrame(rows, "g int, x double, y double"), "g", ["x"], "y").first()["coefficients"]
    x, y = np.array([r[1] - 1e9 for r in rows]), np.array([r[2] - 3e9 for r in rows])
    slope = np.polyfit(x, y, 1)
    assert abs(got[1] - slope[0]) < 1e-9 and abs(got[0] + got[1] * 1e9 - 3e9 - slope[1]) < 1e-5
    assert M.affine_fit(spark.createDataFrame([], "g int, x double, y double"), "g", ["x"], "y").count() == 0


def test_mutation_outcomes(spark):
    base = spark.createDataFrame([(1, "s1", 0), (2, "s2", 5)], "k int, s string, x int")
    outcome = lambda df: M.mutation_outcome(base, df, ["k"], "s", ["x"]).first()["outcome"]
    assert outcome(base) == "IDENTICAL" and outcome(base.where("k = 1")) == "COUNT_CHANGED" and outcome(base.withColumn("x", F.col("x") + 1)) == "TRANSLATION" and outcome(base.withColumn("s", F.lit("q"))) == "STREAM_ONLY"


def test_extremes_take_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 1)], "o int, v int")
    got = df.agg(A.arg_min(F.col("o"), F.col("v"), F.col("o")).alias("low"), A.arg_max(F.col("o"), F.col("v"), F.col("o")).alias("high")).first()
    assert (got["low"], got["high"]) == (3, 1)

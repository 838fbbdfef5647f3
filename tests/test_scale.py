"""Walks, chains, ranks, digests, nested hashes, sinks, snapshots and piecewise functions: what tables of a benchmark do not have."""

import collections
import hashlib
import json
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import piecewise as PW
from quarry.functions import variants as V
from quarry.operators import ranks as K
from quarry.operators import walks as W
from quarry.sources import binary_sink, ranges, versions
from quarry.streaming import snapshots as SN

# ---------------------------------------------------------------- walks and chains


def plain_walk(edges, roots, depth, visits):
    """Per graph: (node, depth, parent) of what is visited, and the end."""
    out, ends = set(), {}
    for graph in {g for g, _ in roots}:
        level = {n: None for g, n in roots if g == graph}
        seen, d, end = {}, 0, ("COMPLETE", 0)
        while level:
            if d > depth:
                end = ("DEPTH_LIMIT", len(level))
                break
            taken = sorted(level)[: visits - len(seen)]
            out |= {(graph, n, d, level[n]) for n in taken}
            seen.update((n, d) for n in taken)
            if len(taken) < len(level):
                end = ("VISIT_LIMIT", len(level) - len(taken))
                break
            below = collections.defaultdict(list)
            for g, a, b in edges:
                if g == graph and a in level and b is not None and b not in seen:
                    below[b].append(a)
            level, d = {n: min(a) for n, a in below.items()}, d + 1
        ends[graph] = (end[0], len(seen), max(seen.values()), end[1])
    return out, ends


@pytest.mark.parametrize(("depth", "visits"), [(64, 1000), (2, 1000), (64, 12), (0, 3)])
def test_walks_against_a_plain_search(spark, depth, visits):
    rng = random.Random(visits)
    edges = [(g, rng.randrange(30), rng.randrange(30)) for g in range(3) for _ in range(45)] + [(1, None, 3), (1, 3, None), (0, 5, 5)]
    edges += [(2, 7, n) for n in range(30)]  # a hub
    roots = [(0, 1), (0, 1), (1, 4), (1, 9), (2, 7), (9, 1)]
    reached, ends = W.walk(spark.createDataFrame(edges, "graph int, source int, target int"), spark.createDataFrame(roots, "graph int, node int"), depth, visits)
    want, want_ends = plain_walk(edges, roots, depth, visits)
    assert {tuple(r) for r in reached.select("graph", "node", "depth", "parent").collect()} == want and reached.count() == len(want)
    assert {r["graph"]: (r["status"], r["visits"], r["depth"], r["unvisited"]) for r in ends.collect()} == want_ends


def receipts(n, broken=()):
    rows, before = [], ""
    for i in range(n):
        digest = hashlib.sha256(f"{before}|{i}".encode()).hexdigest()
        rows.append((i, i - 1 if i else None, str(i) if i not in broken else "other", digest, i, i))
        before = digest
    return rows


SCHEMA = "step long, before long, payload string, digest string, review long, candidate long"


def checked(spark, rows, without=()):
    steps = spark.createDataFrame(rows, SCHEMA)
    covers = F.col("digest") == F.sha2(F.concat_ws("|", F.coalesce("before_digest", F.lit("")), "payload").cast("binary"), 256)
    known = steps.select("review").where(~F.col("review").isin(list(without))) if without else steps.select("review")
    return W.chains(W.step_checks(steps, {"review": ("review", known), "candidate": ("candidate", steps.select("candidate"))}, covers))


def test_a_broken_link_in_a_chain_of_a_thousand_is_named(spark):
    (row,) = checked(spark, receipts(1000, broken={617, 800})).collect()
    assert row.asDict() == {"step": 999, "first": 0, "length": 1000, "faults": 2, "broken": 617, "fault": "digest", "status": "FAIL"}
    (row,) = checked(spark, receipts(1000)).collect()
    assert (row["status"], row["length"], row["broken"]) == ("PASS", 1000, None)
    (row,) = checked(spark, receipts(1000, broken={700}), without=[300]).collect()
    assert (row["broken"], row["fault"], row["faults"]) == (300, "review missing", 2)


def test_chains_with_gaps_branches_and_rings(spark):
    rows = receipts(6)
    gap = [r for r in rows if r[0] != 2]  # 3 has lost its predecessor
    got = {r["step"]: (r["first"], r["length"], r["broken"], r["fault"]) for r in checked(spark, gap).collect()}
    assert got == {1: (0, 2, None, None), 5: (3, 3, 3, "predecessor missing")}
    branch = [*rows, (9, 3, "9", hashlib.sha256(f"{rows[3][3]}|9".encode()).hexdigest(), 9, 9)]
    assert {r["step"]: (r["length"], r["status"]) for r in checked(spark, branch).collect()} == {5: (6, "PASS"), 9: (5, "PASS")}
    ring = spark.createDataFrame([(1, 3, None), (2, 1, None), (3, 2, None), (7, 2, None), (8, None, None)], "step int, before int, fault string")
    assert {r["step"]: r["status"] for r in W.chains(ring, longest=16).collect()} == {1: "CYCLE", 7: "CYCLE", 8: "PASS"}


def test_a_tip_of_the_smallest_number_before_a_ring_gives_one_row(spark):
    ring = spark.createDataFrame([(0, 1, None), (1, 3, None), (2, 1, None), (3, 2, None)], "step int, before int, fault string")
    assert sorted((r["step"], r["status"]) for r in W.chains(ring, longest=16).collect()) == [(0, "CYCLE"), (1, "CYCLE")]


def test_steps_without_a_predecessor_fill_all_partitions(spark, monkeypatch):
    # Most chains are one step long and name no review; others end in the first or the second round.
    before = F.when(F.col("id") % 10 == 1, F.col("id") - 1).when(F.col("id") % 50 == 2, F.col("id") - 1)
    steps = spark.range(8000).select(F.col("id").alias("step"), before.alias("before"), F.when(F.col("id") % 10 == 1, F.col("id")).alias("review"))
    largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    counts = []
    write = W.stored
    monkeypatch.setattr(W, "stored", lambda df, name: (counts.append(largest(df)), write(df, name))[1])
    conf = {"adaptive.enabled": "false", "autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16", "files.openCostInBytes": "0"}
    for name, value in conf.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        checks = W.step_checks(steps, {"review": ("review", steps.select("review"))}, F.lit(True))
        counts.append(largest(checks))
        found = W.chains(checks)
        assert len(counts) >= 4 and max(counts) <= 8000 / 2
        assert {(r["length"], r["status"], r["count"]) for r in found.groupBy("length", "status").count().collect()} == {(1, "FAIL", 6240), (2, "FAIL", 640), (3, "FAIL", 160)}
    finally:
        for name in conf:
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# ---------------------------------------------------------------- ranks and digests


def test_quantiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0, 3.0], [1, 900, 99]), "c": np.array([7.0]), None: np.arange(10.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    shares = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {r["g"]: r["quantiles"] for r in K.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", None, "empty"} and got["empty"] is None
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, shares), rtol=1e-12)
    assert K.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0


def test_quantiles_are_those_of_sql_to_the_last_bit(spark, duck):
    rows = [(str(i % 9), round(random.Random(i).uniform(1, 1e5), 2)) for i in range(3000)]
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE q (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO q VALUES (?, ?)", rows)
    wanted = dict(con.execute("SELECT g, quantile_cont(v, [0.5, 0.9, 0.95, 0.99, 1.0]) FROM q GROUP BY g").fetchall())
    got = K.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.5, 0.9, 0.95, 0.99, 1.0]).collect()
    assert {r["g"]: r["quantiles"] for r in got} == wanted


def test_one_group_of_all_rows_fills_all_partitions(spark):
    rows = spark.range(80_000).select(F.lit("all").alias("g"), F.hash("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = rows.groupBy("g", "v").count().repartitionByRange("g", "v").withColumn("slice", F.spark_partition_id())
        assert max(r["count"] for r in dealt.groupBy("slice").count().collect()) <= 80_000 / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def tree(lines, fan, levels):
    nodes = [hashlib.sha256(f"{x}\n".encode()).hexdigest() for x in lines]
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


def test_digest_trees(spark):
    rows = [("a", i, f"line {i}") for i in range(500)] + [("b", 1, "only")] + [("c", i, None if i == 3 else str(i)) for i in range(9)]
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, o int, line string").repartition(6)
    got = {r["g"]: (r["n"], r["sha256"]) for r in K.ordered_digest(shuffled, ["g"], ["o"], F.col("line"), fan=8, levels=3).collect()}
    assert got == {g: (len(ls), tree(ls, 8, 3)) for g in "abc" for ls in [[x or "" for h, _, x in rows if h == g]]}
    other = shuffled.withColumn("line", F.when((F.col("g") == "a") & (F.col("o") == 250), "changed").otherwise(F.col("line")))
    assert {r["g"]: r["sha256"] for r in K.ordered_digest(other, ["g"], ["o"], F.col("line"), fan=8, levels=3).collect()}["a"] != got["a"][1]


# ---------------------------------------------------------------- nested values


def canonical(v):
    if isinstance(v, dict) and v:
        form = "".join(f"{{{len(k.encode())}:{k}{canonical(v[k])}" for k in sorted(v, key=str.encode))
    elif isinstance(v, list) and v:
        form = "".join(f"[{canonical(x)}" for x in v)
    else:
        tag = {bool: "bool", int: "int", float: "real", str: "str", type(None): "null", list: "array", dict: "object"}[type(v)]
        form = f"{tag}:{v if tag == 'str' else json.dumps(v).removesuffix('.0')}"
    return hashlib.sha256(form.encode()).hexdigest()


def hashed(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return {r["id"]: (r["sha256"], r["fault"]) for r in V.value_hashes(rows, ["id"], "t", **kw).collect()}


def test_canonical_hashes(spark):
    deep = "[" * 6 + "1" + "]" * 6
    values = [1, 1.0, True, "1", None, [], {}, [1, [2, {"a": None}]], {"b": 1, "a": {"y": [1.5, "é"], "x": False}, "é": 0, "10": 1, "9": 2}, [{"path": "x", "n": -3}] * 3, json.loads(deep)]
    got = hashed(spark, [json.dumps(v, ensure_ascii=False) for v in values])
    assert {i: h for i, (h, _) in got.items()} == {i: canonical(v) for i, v in enumerate(values)}
    assert len({h for h, _ in got.values()}) == len(values)
    got = hashed(spark, ['{"a":1,"b":[1.50]}', '{"b":[1.5],"a":1}', '{"a":1,"b":[1.5,0]}', '{"a":1,"a":2}', "no json", None, "[[[1]]]", "[[1]]"], depth=2)
    assert got[0] == got[1] and got[0] != got[2]
    assert (got[3][1], got[4][1], got[6], got[7][1]) == ("malformed", "malformed", (None, "depth"), None) and 5 not in got


def test_leaves_differences_and_references(spark):
    frame = lambda *ts: spark.createDataFrame(list(enumerate(ts)), "id int, t string")
    before, _ = V.leaves(frame('{"a":[1,2],"b":{"path":"x","size":3},"gone":1}', "[]"), ["id"], "t")
    after, _ = V.leaves(frame('{"b":{"size":3,"path":"y"},"a":[1,2,3]}', "[]"), ["id"], "t")
    diff = {(r["id"], r["path"]): (r["before"] is None, r["after"] is None) for r in V.differences(before, after, ["id"]).collect()}
    assert diff == {(0, "$.a[2]"): (True, False), (0, "$.b.path"): (False, False), (0, "$.gone"): (False, True)}
    assert [tuple(r) for r in V.references(before, ["id"], ["path", "size"]).collect()] == [(0, "$.b", "x", "3")]
    assert not any(k in before._jdf.queryExecution().executedPlan().toString() for k in ("Python", "Pandas", "Arrow"))


def test_values_in_rows_and_by_levels_agree(spark, monkeypatch):
    texts = ['{"a":[1,2.50,[]],"b":{"path":"x","size":3},"c.d":true}', "7", "no", '{"path":{"size":1},"size":2}', '[[{"path":1,"size":"\\u00e9"}]]', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    other = spark.createDataFrame([(0, '{"b":{"path":"y"},"a":[1,2.5]}'), (2, "[3]"), (4, "[[1]]"), (9, "[null]")], "id long, t string")
    got = lambda df: sorted(map(repr, df.collect()))
    monkeypatch.setattr(V, "IN_ROW", 2)  # the fifth value has three levels
    found = V.leaves(rows, ["id"], "t")[0]
    assert got(V.value_references(rows, ["id"], "t", ["path", "size"])) == got(V.references(found, ["id"], ["path", "size"]))
    assert got(V.value_differences(rows, other, ["id"], "t")) == got(V.differences(found, V.leaves(other, ["id"], "t")[0], ["id"]))


def test_values_of_few_levels_are_not_written_level_by_level(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("level by level")

    monkeypatch.setattr(V, "_leaves", refuse)
    rows = spark.createDataFrame([(0, '{"a":[{"path":"x","size":3}]}')], "id long, t string")
    assert V.value_hashes(rows, ["id"], "t").count() == 1


# ---------------------------------------------------------------- sinks


def test_a_failed_task_leaves_no_version(spark, tmp_path):
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    version = versions.Version(spark, str(tmp_path), "v1")
    version.put("whole", spark.range(10))
    with pytest.raises(Exception, match="lost"):
        version.put("rows", broken)
    for use in (lambda: versions.read_version(spark, version.path, "rows"), version.publish, lambda: version.put("more", spark.range(1))):
        with pytest.raises(PermissionError):
            use()
    assert versions.report_of(spark, version.path)["status"] == "FAIL" and not list(tmp_path.glob("v1/data-*"))
    with pytest.raises(FileExistsError):
        versions.Version(spark, str(tmp_path), "v1")


def test_of_two_writers_one_gets_the_name(spark, tmp_path):
    first = versions.Version(spark, str(tmp_path), "v")
    with pytest.raises(FileExistsError):
        versions.Version(spark, str(tmp_path), "v")
    first.put("t", spark.range(5))
    manifest = first.publish()
    assert manifest["tables"] == {"t": 5} and manifest["files"] > 0
    assert {r["status"] for r in versions.verified(spark, first.path).collect()} == {"OK"}
    part = next(tmp_path.glob("v/data-*/t/part-*"))
    part.with_name(f".{part.name}.crc").unlink()  # else the file system finds it
    part.write_bytes(part.read_bytes() + b"x")
    assert "CHANGED" in {r["status"] for r in versions.verified(spark, first.path).collect()}
    with pytest.raises(PermissionError):
        first.failed()


def test_budgets_stop_a_run_and_leave_a_report(spark, tmp_path):
    with pytest.raises(versions.LimitPassed), versions.Version(spark, str(tmp_path), "big", versions.Budget(output_rows=100)) as v:
        v.put("some", spark.range(60))
        v.put("more", spark.range(60))
    report = versions.report_of(spark, f"{tmp_path}/big")
    assert (report["status"], report["limit"], report["most"], report["found"]) == ("LIMIT", "output_rows", 100, 120)
    spark.range(1000).write.parquet(f"{tmp_path}/in")
    given = spark.read.parquet(f"{tmp_path}/in")
    size = versions.input_bytes(given)
    assert size > 0
    steps = [("read", lambda: given), ("again", lambda: given.limit(5)), ("last", lambda: given)]
    result, receipts = versions.within(versions.Budget(input_bytes=size), steps)
    assert result is None and [(r["step"], r["status"], r["limit"]) for r in receipts] == [("read", "PASS", None), ("again", "LIMIT", "input_bytes"), ("last", "NOT_RUN", None)]
    result, receipts = versions.within(versions.Budget(), steps[:2])
    assert result.count() == 5 and [r["rows"] for r in receipts] == [1000, 5]
    with pytest.raises(versions.LimitPassed):
        versions.Budget(seconds=-1.0).spend()


def test_binary_files_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", bytearray(b"1")), ("d/b.bin", bytearray(b"22")), ("d/b.bin", bytearray(b"33")), ("empty", None)], "name string, content binary").coalesce(1)
    binary_sink.write_files(rows, f"file://{tmp_path}/out")
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a.bin": b"1", "d/b.bin": b"2233", "empty": b""}
    assert sorted(n.rsplit("/out/", 1)[1] for n, _ in ranges.files_of(f"file://{tmp_path}/out")) == ["a.bin", "d/b.bin", "empty"]
    with pytest.raises(Exception, match="FileExists"):
        binary_sink.write_files(rows.limit(1), f"{tmp_path}/out")
    for bad in ("../x", "/x", "", "_hidden", None):
        with pytest.raises(Exception, match="no name"):
            binary_sink.write_files(spark.createDataFrame([("fine", bytearray(b"1")), (bad, bytearray(b"2"))], "name string, content binary").coalesce(1), f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="two partitions"):
        binary_sink.write_files(spark.createDataFrame([("x", bytearray(b"1")), ("x", bytearray(b"2"))], "name string, content binary").repartition(2), f"{tmp_path}/twice")


# ---------------------------------------------------------------- snapshots


def test_snapshots_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    parts = []
    for session in "abc":
        for tick in range(12):
            start, n = tick * 50 + rng.randrange(20), rng.randint(1, 4)
            parts += [(session, tick, p, n, start + rng.randrange(16)) for p in range(n) if rng.random() < 0.9]
            parts += [(session, tick, 0, n, start + 3)] * rng.randrange(2)  # equal parts
    rng.shuffle(parts)
    frame = lambda rows: spark.createDataFrame(rows, "session string, tick long, part long, parts int, s long").select("session", "tick", "part", "parts", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"))
    for i in range(4):
        frame(parts[i::4]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i, s in enumerate((100_000, 100_001, 200_000, 200_001), 4):
        frame([("end", i, 0, 2, s)]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frame(parts).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = SN.snapshots(stream, 10_000, "1 hour").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination()
    rows = spark.read.schema(SN.DECIDED).parquet(f"{tmp_path}/out").where("session <> 'end'").collect()
    want = {(r["session"], r["tick"]): (r["at"], r["seen"], r["complete"]) for r in SN.decided(frame(parts), 10_000).collect()}
    assert {(r["session"], r["tick"]): (r["at"], r["seen"], r["status"] != SN.INCOMPLETE) for r in rows} == want and len(rows) == len(want)
    last = {r["session"]: (r["tick"], r["at"]) for r in SN.latest_complete(frame(parts), 10_000).collect()}
    got = {s: max((r["at"], r["tick"]) for r in rows if r["session"] == s and r["status"] == SN.COMPLETE)[::-1] for s in "abc"}
    assert got == last
    left = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/c").where("key.session <> 'end'")
    assert left.count() == 0
    assert spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/c").where("key.session <> 'end'").count() == 0


class CountedState(dict):
    """Map or value state in memory that counts what would be calls to a state store."""

    calls = 0

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("calls", "items"):
            CountedState.calls += 1
        return super().__getattribute__(name)

    def getMapState(self, *_):
        return CountedState()

    getValueState = getMapState

    def registerTimer(self, at):
        self[at] = True

    def exists(self):
        return len(self) > 0

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, key):
        del self[key]

    def get(self):
        return self[0]

    def update(self, value):
        self[0] = value

    def containsKey(self, key):
        return key in self


class Watermark(int):
    def getCurrentWatermarkInMs(self):
        return int(self)


def test_snapshots_call_the_state_store_about_once_a_snapshot():
    processor, handle = SN.Snapshots(1000, 1000), CountedState()
    processor.init(handle)
    rows = [(tick, part, 4, tick * 10 + part) for part in range(4) for tick in range(500)]
    CountedState.calls = 0
    list(processor.handleInputRows(("s",), iter([pd.DataFrame(rows[:900], columns=["tick", "part", "parts", "ms"]), pd.DataFrame(rows[900:], columns=["tick", "part", "parts", "ms"])]), None))
    assert CountedState.calls < 1.1 * 500
    early = pd.concat(processor.handleExpiredTimer(("s",), Watermark(3000), None))
    late = pd.concat(processor.handleExpiredTimer(("s",), Watermark(10_000), None))
    assert early["tick"].tolist() == list(range(201)) and late["tick"].tolist() == list(range(201, 500))
    assert set(early["status"]) | set(late["status"]) == {SN.COMPLETE} and CountedState.calls < 2 * 500
    assert {1000, 201 * 10 + 1000} <= set(handle)  # the timers of the first one and of the first one left


# ---------------------------------------------------------------- piecewise functions


def test_piecewise_values_at_all_borders(spark):
    pieces = [PW.Piece(-5, 0, Fraction(-7, 6), Fraction(1, 4)), PW.Piece(0, 1, Fraction(0), Fraction(0)), PW.Piece(1, 40, Fraction(10, 15), Fraction(-3)), PW.Piece(50, 51, Fraction(1), Fraction(9, 10))]
    rows = spark.range(-8, 60).select(F.col("id").alias("x")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("x")))
    got = {r["x"]: r["v"] and Fraction(r["v"]["numerator"], r["v"]["denominator"]) for r in rows.select("x", PW.value(F.col("x"), pieces).alias("v")).collect()}
    want = {x: next((p.slope * x + p.offset for p in pieces if p.start <= x < p.stop), None) for x in range(-8, 60)} | {None: None}
    assert got == want
    lowest = rows.select(PW.value(F.col("x"), pieces).alias("v")).where("v IS NOT NULL").collect()
    assert all(Fraction(r["v"]["numerator"], r["v"]["denominator"]).denominator == r["v"]["denominator"] for r in lowest)
    with pytest.raises(ValueError, match="overlap"):
        PW.value(F.col("x"), [PW.Piece(0, 5, Fraction(1), Fraction(0)), PW.Piece(4, 9, Fraction(1), Fraction(0))])


def test_pieces_of_very_different_sizes(spark):
    rng = random.Random(2)
    bounds = sorted(rng.sample(range(-1000, 100_000), 200) + [1 << 40, 1 << 41])
    table = [(a, b, i) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if i % 3] + [(5, 5, -1)]
    xs = [rng.randrange(-1100, 101_000) for _ in range(500)] + [1 << 40, (1 << 41) - 1, 1 << 41, None, *bounds]
    got = PW.piece_of(spark.createDataFrame([(x,) for x in xs], "x long"), "x", spark.createDataFrame(table, "start long, stop long, i int"))
    count = collections.Counter((r["x"], r["i"]) for r in got.collect())
    assert count == collections.Counter((x, None if x is None else next((i for a, b, i in table if a <= x < b), None)) for x in xs)


def test_pieces_move_each_row_once_also_where_many_share_a_place(spark, monkeypatch):
    from quarry.operators import slices

    monkeypatch.setattr(slices, "SLICE_ROWS", 40)
    table = [(0, 1, 0), (1, 3, 1), (3, 5000, 2), (6000, 6001, 3)]
    xs = [0] * 300 + [2] * 300 + list(range(7000, -10, -7)) + [None] * 3
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x long")
    found = PW.piece_of(rows, "x", spark.createDataFrame(table, "start long, stop long, i int"))
    assert sorted((r["id"], r["i"]) for r in found.collect()) == [(i, None if x is None else next((p for a, b, p in table if a <= x < b), None)) for i, x in enumerate(xs)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_digests_do_not_move_whole_nodes_again(spark):
    """What the last shuffles move grows with nodes and borders, not with rows."""
    rows = spark.range(0, 40_000, 1, 4).select(F.lit("a").alias("g"), F.col("id").alias("o"))
    found = K.ordered_digest(rows, ["g"], ["o"], F.col("o").cast("string"), fan=100, levels=3)
    assert found.first()["sha256"] == tree([str(i) for i in range(40_000)], 100, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_files_of_a_version_are_hashed_by_many_tasks(spark, tmp_path, monkeypatch):
    """Only the lines of the manifest meet in one task, not the files."""
    from pyspark import TaskContext
    from pyspark.sql import types as T

    @F.udf(T.IntegerType())
    def task(_):
        return TaskContext.get().partitionId()

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        listing = versions.listing
        monkeypatch.setattr(versions, "listing", lambda *a: listing(*a).withColumn("task", task("sha256")))
        version = versions.Version(spark, str(tmp_path), "many")
        version.put("t", spark.range(0, 8000, 1, 8))
        version.publish()
        assert spark.read.parquet(f"{version.path}/manifest-{version.attempt}").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

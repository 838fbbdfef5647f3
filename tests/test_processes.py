"""Outside programs: every input gives a row."""

import sys

import pytest

from quarry.operators import audit
from quarry.sources.processes import run_bounded, run_for_rows


def test_receipts(spark):
    rows = spark.createDataFrame([("a", b"abc"), ("b", b""), ("c", None), ("d", b"x" * 100)], "k string, d binary")
    program = "import sys; d = sys.stdin.buffer.read(); sys.exit(3) if not d else sys.stdout.buffer.write(d.upper())"
    got = {r["key"]: r for r in run_for_rows(rows, "k", "d", [sys.executable, "-c", program], most=50).collect()}
    assert bytes(got["a"]["output"]) == b"ABC" and got["a"]["status"] == "COMPLETE"
    assert [got[k]["status"] for k in "bcd"] == ["PROCESS_FAILURE", "PROCESS_FAILURE", "OUTPUT_LIMIT"]
    slow = run_for_rows(rows.limit(1), "k", "d", [sys.executable, "-c", "import time; time.sleep(9)"], seconds=0.5).first()
    assert slow["status"] == "TIMEOUT" and run_for_rows(rows.limit(1), "k", "d", ["/no/such/program"]).first()["status"] == "NOT_STARTED"


def test_limits_of_a_child():
    endless = run_bounded([sys.executable, "-c", "while True: print('x' * 1000)"], b"", 20, 10_000)
    assert endless["status"] == "OUTPUT_LIMIT" and endless["output"] is None and endless["seconds"] < 10
    exact = run_bounded([sys.executable, "-c", "print('x' * 99)"], b"", 20, 100)
    assert exact["status"] == "COMPLETE" and len(exact["output"]) == 100 and exact["peak_kib"] > 1000 and exact["cpu_seconds"] >= 0
    busy = run_bounded([sys.executable, "-c", "while True: pass"], b"", 20, 100, cpu=1)
    assert busy["status"] == "CPU_LIMIT" and busy["seconds"] < 10
    large = run_bounded([sys.executable, "-c", "x = bytearray(1 << 30)"], b"", 20, 100, memory=256 << 20)
    assert large["status"] == "PROCESS_FAILURE" and "MemoryError" in large["diagnostic"]
    deaf = run_bounded([sys.executable, "-c", "print(1)"], b"x" * (1 << 22), 20, 100)
    assert deaf["status"] == "COMPLETE" and deaf["output"] == b"1\n"


def test_chains_of_one_and_many(spark):
    rows = [(1, 2), (2, 3), (3, None), (9, None)] + [(k, k + 1) for k in range(100, 150)] + [(150, None)]
    got = {r["node"]: (r["head"], r["place"]) for r in audit.chains(spark.createDataFrame(rows, "node int, next int")).collect()}
    assert [got[k] for k in (1, 2, 3, 9, 100, 150)] == [(1, 0), (1, 1), (1, 2), (9, 0), (100, 0), (100, 50)]
    with pytest.raises(ValueError):
        audit.chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, next int"), deepest=64)
    assert audit.chains(spark.createDataFrame([], "node int, next int")).count() == 0


def test_a_role_given_twice_makes_no_row_twice(spark):
    roles = spark.createDataFrame([("d", "x"), ("d", "y"), ("a", "z")], "name string, role string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, key string")
    assert sorted((r["id"], r["role"]) for r in audit.role_of(rows, roles, "key", "d").collect()) == [(1, "z"), (2, "x")]

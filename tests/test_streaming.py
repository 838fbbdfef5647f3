"""Streams run to their end over files and must agree with the batch."""

import pytest
from pyspark.sql import functions as F

from quarry.streaming import events as E


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp_seconds(1700000400 + id * 60) AS ts, id % 3 AS user, if(id % 2 = 0, 'open', 'close') AS op, cast(id AS double) AS value FROM range(120)")
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    return lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_windowed_counts(spark, stream):
    rows = drain(E.windowed(stream(), "ts", ["user"], "10 minutes", "5 minutes", "value"), "windows")
    assert rows and all(r["n"] in (3, 4) for r in rows)


def test_correlation(spark, stream):
    s = stream()
    opened = s.where("op = 'open'")
    closed = s.where("op = 'close'")
    pairs = drain(E.correlate(opened, closed, "user", "ts", "5 minutes", "1 hour").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), "pairs")
    want = {(a, b) for a in range(0, 120, 2) for b in range(1, 120, 2) if a % 3 == b % 3 and a < b <= a + 5}
    assert {(r["a"], r["b"]) for r in pairs} == want


def test_lifetimes(spark, stream):
    delta = stream().withColumn("d", F.when(F.col("op") == "open", 1).otherwise(-1))
    rows = drain(E.lifetimes(delta, "user", "d", "id"), "lives", "update")
    assert {r["key"] for r in rows} == {"0", "1", "2"} and all(r["opened"] == 20 and r["live"] in (0, 1) for r in rows)


def test_lifetimes_in_event_order_across_batches(spark, tmp_path):
    """The closing comes a batch before its opening, and a later batch moves the watermark past both."""
    kind = "user string, ts timestamp, d int"
    batches = [[("a", 100, -1), ("b", 100, 1)], [("a", 50, 1), ("b", 90, -1)], [("a", 2_000, 1), ("b", 2_000, 1)], [("a", 9_000, -1)], [("z", 20_000, 1)], [("z", 20_001, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user string, s long, d int").selectExpr("user", "timestamp_seconds(1700000000 + s) AS ts", "d").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = E.ordered_lifetimes(stream, "user", "d", "ts", "10 minutes").writeStream.format("memory").queryName("ordered").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("ordered").collect()
    last = {k: max(((r["opened"], r["closed"], r["violations"]) for r in rows if r["key"] == k)) for k in ("a", "b")}
    assert last["a"][:2] == (2, 2) and last["a"][2] == 0  # in order of time the opening comes first
    assert last["b"] == (2, 0, 1)  # the closing at 90 has no opening before it

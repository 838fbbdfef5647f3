"""Table functions in SQL."""

from quarry.sources import visitors
from quarry.sources.records import write_stream


def test_lateral_table_functions(spark):
    visitors.register(spark)
    visitors.visitor(spark, "byte_rows", lambda data: ((i, b) for i, b in enumerate(data)), "place int, byte int")
    spark.createDataFrame([(1, write_stream([65, 66])), (2, b""), (3, None)], "id int, data binary").createOrReplaceTempView("streams")
    rows = spark.sql("SELECT id, g.* FROM streams, LATERAL glyph_rows(data, 100) g").collect()
    assert sorted((r["id"], r["kind"], r["code"]) for r in rows if r["kind"] == "glyph") == [(1, "glyph", 65), (1, "glyph", 66)]
    assert {r["id"]: r["kind"] for r in rows if r["kind"] != "glyph"} == {1: "TERMINATOR", 2: "MALFORMED"}
    spark.createDataFrame([(b"1 0 (a) Tj",)], "data binary").createOrReplaceTempView("contents")
    assert [r["kind"] for r in spark.sql("SELECT t.* FROM contents, LATERAL token_rows(data) t ORDER BY ordinal").collect()] == ["number", "number", "string", "word"]
    assert spark.sql("SELECT count(*) AS n FROM streams, LATERAL byte_rows(data)").first()["n"] == len(write_stream([65, 66]))


def test_visited_records_are_spread_over_tasks(spark, sf):
    from quarry.plans import readers
    from quarry.sources.records import glyph_columns, read_stream

    plan = readers.QUERIES["visited_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    for data in (write_stream(range(300)), write_stream([])[:-4], b"", b"\1"):
        status, offset, columns = glyph_columns(data, 200)
        one = read_stream(data, 200)
        assert (status, offset) == (one["status"], one["offset"])
        assert list(zip(*columns, strict=True)) == [(g["offset"], g["x"], g["y"], g["code"]) for g in one["glyphs"]]

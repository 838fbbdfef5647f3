"""Nested documents: leaves, outlines, XML and structural differences."""

from pyspark.sql import functions as F

from quarry.functions import nested as N


def rows(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.orderBy("i").select(column(F.col("t")).alias("v")).collect()]


def test_leaves(spark):
    got = rows(spark, N.leaves, ['{"a": [1, {"b": null}], "c": {}}', '{"a": 1, "a": 2}', "NaN", "", None, "[" * 200 + "]" * 200])
    assert [(x["path"], x["value"]) for x in got[0]] == [("$.a[0]", "1"), ("$.a[1].b", "null"), ("$.c", "{}")] and got[1:] == [None] * 5


def test_preorder(spark):
    text = '[{"title": "A", "page": 1, "kids": [{"title": "B", "kids": [{"title": "C"}]}, {"title": "D", "page": 3}]}, {"title": "E"}]'
    got = rows(spark, N.preorder, [text, '[{"page": 1}]', None])
    assert [(x["depth"], x["title"], x["page"]) for x in got[0]] == [(0, "A", 1), (1, "B", None), (2, "C", None), (1, "D", 3), (0, "E", None)] and got[1:] == [None, None]


def test_xml(spark):
    got = rows(spark, N.xml_shape, ['<r z="1" a="2">é<x/></r>', '<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>', "<r>", None])
    assert [(x["tag"], x["attributes"], x["text_bytes"]) for x in got[0]] == [("r", ["a", "z"], 2), ("x", [], 0)] and got[1:] == [None] * 3
    page = '<document><page number="{}"><MediaBox l="0" b="0" r="{}" t="20"/></page></document>'
    pages = rows(spark, N.xml_pages, [page.format(1, 10), page.format(2, 10), page.format(1, -1), None])
    assert [(p["number"], p["width"], p["height"]) for p in pages[0]] == [(1, 10.0, 20.0)] and pages[1:] == [None] * 3


def test_manifest_diff(spark):
    a = spark.createDataFrame([(1, '{"x": 1, "y": [1, 2]}'), (2, "{}")], "k int, t string")
    b = spark.createDataFrame([(1, '{"x": 1, "y": [1, 3], "z": true}'), (2, "{}")], "k int, t string")
    assert sorted((r["k"], r["path"], r["before"] is None) for r in N.manifest_diff(a, b, ["k"], "t").collect()) == [(1, "$.y[1]", False), (1, "$.z", True)]

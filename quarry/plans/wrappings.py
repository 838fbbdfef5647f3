"""Queries of what surrounds documents, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import generators as G
from quarry.sources import pdf_pages as P
from quarry.sources import wrappers as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query("""
WITH n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, i::INTEGER AS page, n_nationkey || ' 0 R' AS object, (n_nationkey % 3)::INTEGER AS contents FROM n WHERE n_regionkey <> 2""")
def page_listings(spark, sf):
    """Pages of listings with their objects; one listing has none."""
    contents = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("n_nationkey") % 3).cast("int"))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(" 0 R")).alias("object"), contents.alias("contents")))).alias("r"))
    pages = F.when(F.col("n_regionkey") != 2, F.col("r")).otherwise(F.slice("r", 1, 0))
    text = F.to_json(F.struct(F.transform(pages, lambda r: F.struct(r["object"].alias("object"), r["contents"].alias("contents"))).alias("pages")))
    return rows.select("n_regionkey", F.explode(W.listed_pages(text)).alias("p")).select("n_regionkey", "p.page", "p.object", F.size("p.contents").alias("contents"))


@query("""
WITH f AS (SELECT p_partkey, unnest(['Id', 'Key', 'Note']) AS name, unnest([length(md5(p_name)), 24, 3]) AS characters, unnest([24, 16, NULL]) AS bytes, unnest([false, p_partkey % 2 = 0, NULL]) AS sequence, unnest([false, true, NULL]) AS whole_blocks FROM part)
SELECT p_partkey, name, characters::INTEGER AS characters, bytes::INTEGER AS bytes, sequence, whole_blocks FROM f""")
def wrapper_inventories(spark, sf):
    """Fields of rights wrappers: lengths, encoded bytes and what these begin with."""
    digest = F.md5(F.col("p_name").cast("binary"))
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("3082"), F.substring(digest, 5, 28))).otherwise(F.concat(F.lit("0000"), F.substring(digest, 5, 28)))
    xml = F.concat(F.lit("<Rights><Id>"), digest, F.lit("</Id><Key>"), F.base64(F.unhex(key)), F.lit("</Key><Note>a-b</Note></Rights>"))
    return table(spark, sf, "part").select("p_partkey", F.explode(W.wrapper_fields(xml)).alias("f")).select("p_partkey", "f.*")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN octet_length(encode(p_name)) + 16 END::INTEGER AS document, CASE WHEN p_partkey % 4 <> 3 THEN p_size END::INTEGER AS wrapper FROM part""")
def wrapped_extents(spark, sf):
    """Where documents end and what is wrapped behind them begins; a fourth has no end mark."""
    mark = F.when(F.col("p_partkey") % 4 == 3, "%%OEF").otherwise("%%EOF")
    early = F.when(F.col("p_partkey") % 4 == 3, "%%OEF").otherwise("%%EOF")
    data = F.concat(F.lit("%PDF-1"), early, F.col("p_name"), mark, F.repeat(F.lit("w"), F.col("p_size").cast("int"))).cast("binary")
    return table(spark, sf, "part").select("p_partkey", W.extents(data).alias("e")).select("p_partkey", "e.document", "e.wrapper")


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'PARSED' WHEN 1 THEN 'UNRESOLVED' ELSE 'NO_FINAL_MARKER' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 'app=1,item=' || (1 + n_nationkey % 2) ELSE '' END AS elements FROM nation""")
def trailing_packages(spark, sf):
    """Packages behind a final marker, with the elements that they hold."""
    kind = F.col("n_nationkey") % 3
    items = F.when(F.col("n_nationkey") % 2 == 1, "<item/><item/>").otherwise("<item/>")
    tail = F.when(kind == 0, F.concat(F.lit("APPINFO?APPINFO<app>"), items, F.lit("</app>"))).when(kind == 1, "APPINFO<app>").otherwise("nothing")
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat(F.col("n_name"), tail).cast("binary").alias("data"))
    return W.trailing_packages(rows, ["n_nationkey"], "data", b"APPINFO")


@query("""
SELECT doc_id, 200::BIGINT AS variant, len(string_split(text, chr(10)))::BIGINT AS pages, (80 + 20 * len(string_split(text, chr(10))))::BIGINT AS first_page FROM documents""")
def container_headers(spark, sf):
    """Numbers of containers' headers, and where the first page begins."""
    docs = table(spark, sf, "documents").select("doc_id", G.container_of_lines("text").alias("c"))
    return docs.select("doc_id", W.fields_of(F.col("c"), {"variant": (0, 4), "pages": (8, 4), "first_page": (0x50, 4)}).alias("h")).select("doc_id", "h.*")


@query("""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 2 AS n, l_partkey AS o, l_quantity::BIGINT AS s FROM lineitem)
SELECT k AS source, min(o)::BIGINT AS first, max(o + s)::BIGINT AS last, max(n) + 1 AS free, max(o) FILTER (n = 2) AS found FROM l GROUP BY 1""")
def rebuilt_indexes(spark, sf):
    """Indexes made anew over the objects that are there, and the second object's entry looked up in them."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) * 2
    objects = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), number.cast("long").alias("number"), F.col("l_partkey").cast("long").alias("offset"), F.col("l_quantity").cast("long").alias("size"))
    made = W.rebuilt_index(objects)
    return made.select("source", "first", "last", "free", P.xref_entry(F.col("index").cast("binary"), F.lit(0), F.lit(2).cast("long"))["offset"].alias("found"))


@query("""
WITH s AS (SELECT s_suppkey, s_name, octet_length(encode(s_name)) AS n FROM supplier), w AS (SELECT *, unnest(range(n + 4)) AS start FROM s), c AS (SELECT *, unnest(['utf-8', 'gb18030']) AS codec FROM w)
SELECT s_suppkey, start::INTEGER AS start, codec, greatest(n, start)::INTEGER AS stop, true AS terminated, s_name[start + 1:] AS title FROM c""")
def title_candidates(spark, sf):
    """Every title that may stand in a record, by start and codec."""
    record = F.concat(F.encode("s_name", "UTF-8"), F.unhex(F.lit("00000000")))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(W.title_windows(["utf-8", "gb18030"])(record)).alias("t")).select("s_suppkey", "t.*")

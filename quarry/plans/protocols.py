"""Queries of character codes, ledgers, framed streams and line protocols, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import characters as C
from quarry.operators import aggregates as A
from quarry.operators import ledgers as G
from quarry.sources import framed as R

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
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 33 + l_partkey % 100 WHEN 1 THEN 41889 + l_partkey % 100 ELSE 41377 END AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN code = 41377 THEN ' ' WHEN code BETWEEN 33 AND 126 THEN chr(code::INTEGER) WHEN code BETWEEN 41889 AND 41982 THEN chr((code - 41856)::INTEGER) ELSE '?' END AS character FROM c""")
def mapped_characters(spark, sf):
    """Codes by aliases, ranges and a fallback."""
    kind = F.col("l_linenumber") % 3
    code = F.when(kind == 0, 33 + F.col("l_partkey") % 100).when(kind == 1, 0xA3A1 + F.col("l_partkey") % 100).otherwise(0xA1A1)
    found = C.character(code, [(0x21, 0x7E, 0), (0xA3A1, 0xA3FE, 0xA380)], {0xA1A1: " "}, F.lit("?"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("character"))


@query("""
WITH d AS (SELECT p_partkey, ['Fit', 'FitH', 'XYZ', 'FitR', 'Other'][p_partkey % 5 + 1] AS kind, p_size % 5 AS n FROM part)
SELECT p_partkey, CASE WHEN (kind = 'Fit' AND n = 0) OR (kind = 'FitH' AND n = 1) OR (kind = 'XYZ' AND n = 3) OR (kind = 'FitR' AND n = 4) THEN kind || '(' || array_to_string(range(n), ',') || ')' END AS destination FROM d""")
def tagged_destinations(spark, sf):
    """Destinations whose kind takes as many numbers as there are."""
    kind = F.element_at(F.array(*map(F.lit, ["Fit", "FitH", "XYZ", "FitR", "Other"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    n = F.col("p_size") % 5
    numbers = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n)
    found = table(spark, sf, "part").select("p_partkey", C.destination(kind, numbers).alias("d"))
    return found.select("p_partkey", F.when(F.col("d").isNotNull(), F.concat(F.col("d.kind"), F.lit("("), F.array_join("d.numbers", ","), F.lit(")"))).alias("destination"))


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 4 <> 3 OR NOT regexp_matches(text, '[^\x00-\x17\x20-\x7E]') THEN text END AS title FROM documents""")
def document_titles(spark, sf):
    """Whole texts as titles in the four forms that documents have; null where the form of single bytes cannot hold the text."""
    kind, text = F.col("doc_id") % 4, F.col("text")
    single = F.when(~F.rlike(text, F.lit(r"[^\x00-\x17\x20-\x7E]")), F.encode(text, "ISO-8859-1"))
    data = F.when(kind == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(single)
    return table(spark, sf, "documents").select("doc_id", C.document_title(data).alias("title"))


@query("""
WITH p AS (SELECT p_partkey, upper(md5(p_name)) AS h FROM part) SELECT p_partkey, CASE WHEN p_partkey % 9 <> 4 THEN h[1:8] END AS bits FROM p""")
def packed_samples(spark, sf):
    """Samples that are black or white only, packed to bits; a grey one makes the value null."""
    bits = F.lpad(F.conv(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 8), 16, 2), 32, "0")
    samples = F.unhex(F.replace(F.replace(bits, F.lit("0"), F.lit("F")), F.lit("1"), F.lit("0")))
    wide = F.unhex(F.array_join(F.transform(F.regexp_extract_all(F.hex(samples), F.lit("(.)"), F.lit(1)), lambda c: F.concat(c, c)), ""))
    grey = F.when(F.col("p_partkey") % 9 == 4, F.concat(F.substring(wide, F.lit(1), F.lit(31)), F.unhex(F.lit("7F")))).otherwise(wide)
    return table(spark, sf, "part").select("p_partkey", F.hex(C.packed_bits(grey)).alias("bits"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts, value > 150 AS late FROM events), c AS (SELECT *, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM e)
SELECT event_id, CASE WHEN late THEN 'TOO_LATE' WHEN n <= 5 THEN 'ADMITTED' ELSE 'OVER_LIMIT' END AS admission FROM c""")
def admissions(spark, sf):
    """The first five events of each kind and user that are not late."""
    events = table(spark, sf, "events")
    return G.admitted(events, ["user_id", "event_type"], ["ts", "event_id"], F.lit(5), F.col("value") > 150).select("event_id", "admission")


@query("""
SELECT doc_id, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) <= 100000 AS fits FROM documents""")
def byte_budgets(spark, sf):
    """Documents of each source in order, against a budget of bytes."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    return G.within_budget(docs, ["source"], ["doc_id"], F.col("n"), F.lit(100_000)).select("doc_id", "used", "fits")


@query("""
WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'ADMITTED' WHEN 'error' THEN 'FAIL' ELSE 'COMPLETE' END AS s FROM events), o AS (SELECT user_id, arg_max(s, event_id) AS s FROM l GROUP BY 1)
SELECT user_id, CASE WHEN s = 'ADMITTED' THEN 'UNKNOWN_AFTER_ADMISSION' ELSE s END AS status FROM o""")
def effect_outcomes(spark, sf):
    """What became of each user's effect in an append-only log."""
    status = F.when(F.col("event_type") == "click", "ADMITTED").when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE")
    return G.outcomes(table(spark, sf, "events").withColumn("s", status), ["user_id"], "event_id", "s")


@query("""
WITH t AS (SELECT conv_id, turn, text, role, lag(text) OVER w AS before, lag(role) OVER w AS owner FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(text <> before AND role <> owner, false) AS fresh FROM t""")
def fresh_payloads(spark, sf):
    """Turns that say something else than the turn before, by another speaker."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").withColumns({"before": F.lag("text").over(w), "owner": F.lag("role").over(w)})
    return turns.select("conv_id", "turn", G.fresh(F.col("text"), F.col("before"), F.col("role"), F.col("owner")).alias("fresh"))


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 5 = 2 THEN 'TRUNCATED' ELSE 'COMPLETE' END AS status, (len(t) - CASE WHEN conv_id % 5 = 2 THEN 1 ELSE 0 END)::INTEGER AS n_frames, sha256(array_to_string(t[1:len(t) - CASE WHEN conv_id % 5 = 2 THEN 1 ELSE 0 END], '')) AS sha256 FROM c""")
def framed_artifacts(spark, sf):
    """Turns as frames of one stream, read back; every fifth stream lacks its last byte."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    stream = R.framed(F.transform("t", lambda t: F.encode(t["text"], "UTF-8")))
    cut = F.when(F.col("conv_id") % 5 == 2, F.substring("s", F.lit(1), F.octet_length("s") - 1)).otherwise(F.col("s"))
    read = turns.select("conv_id", stream.alias("s")).select("conv_id", R.frames()(cut).alias("f"))
    return read.select("conv_id", "f.status", F.size("f.frames").alias("n_frames"), F.sha2(F.unhex(F.array_join(F.transform("f.frames", F.hex), "")), 256).alias("sha256"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE conv_id % 6 WHEN 1 THEN 'UNKNOWN_KIND' WHEN 2 THEN 'FIELD_COUNT' WHEN 3 THEN 'ORDER' WHEN 4 THEN 'UNFINISHED' ELSE 'PASS' END AS status, CASE conv_id % 6 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 * n + 2 END::INTEGER AS line,
  (n + CASE WHEN conv_id % 6 = 4 THEN 1 ELSE 0 END)::INTEGER AS pages, (n + CASE WHEN conv_id % 6 = 3 THEN 1 ELSE 0 END)::INTEGER AS boxes FROM c""")
def line_protocols(spark, sf):
    """A head, pages with their boxes, in order; some texts break one rule."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("l")))).alias("t"))
    kind = F.col("conv_id") % 6
    odd = F.when(kind == 1, "X\t1\n").when(kind == 2, "R\t1\t2\n").when(kind == 3, "B\t1\t2\n").otherwise("")
    pages = F.array_join(F.transform("t", lambda t: F.concat(F.lit("P\t"), t["turn"].cast("string"), F.lit("\nB\t"), t["turn"].cast("string"), F.lit("\t"), t["l"].cast("string"), F.lit("\n"))), "")
    text = F.concat(F.lit("H\t1\n"), odd, pages, F.when(kind == 4, "P\t99\n").otherwise(""))
    found = R.protocol(text, {"H": 2, "P": 2, "B": 3, "R": 2}, {"H": [""], "P": ["H", "B", "R", "X"], "B": ["P"], "R": ["H", "B"]}, ["B", "R"])
    return turns.select("conv_id", found.alias("f")).select("conv_id", "f.status", "f.line", F.col("f.counts.P").alias("pages"), F.col("f.counts.B").alias("boxes"))


@query("""
SELECT n_regionkey, sha256(string_agg('/' || n_regionkey || '/' || n_name || ' ' || sha256(n_name), chr(10) ORDER BY '/' || n_regionkey || '/' || n_name) || chr(10)) AS sha256 FROM nation GROUP BY 1""")
def tree_hashes(spark, sf):
    """One hash of all files of a tree, in the order of their paths."""
    path = F.concat(F.lit("/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(A.ordered_sha256(F.concat_ws(" ", path, F.sha2("n_name", 256)), path).alias("sha256"))


@query("""
WITH o AS (SELECT o_orderkey AS k, [1, 3] AS pages FROM orders), x AS (SELECT k, unnest(pages) AS p, unnest(range(len(pages))) AS i FROM o)
SELECT k AS o_orderkey, i::INTEGER AS place, p::INTEGER AS page, l_partkey, round(abs(l_extendedprice - l_quantity * 1000), 2)::DOUBLE AS residual FROM x JOIN lineitem ON l_orderkey = k AND l_linenumber = p""")
def selected_draws(spark, sf):
    """Page lists split, zipped with their places and joined to what was drawn."""
    wanted = table(spark, sf, "orders").select("o_orderkey", F.posexplode(F.split(F.lit("1,3"), ",")).alias("place", "page")).withColumn("page", F.col("page").cast("int"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000), 2).cast("double").alias("residual"))
    return wanted.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("page") == F.col("l_linenumber"))).select("o_orderkey", "place", "page", "l_partkey", "residual")

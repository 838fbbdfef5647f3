"""Queries of portable documents' pages that are built from the tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import pdf_pages as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _contents(spark, sf, text):
    """A page for each order: what ``text`` makes of its lines, in order."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").cast("binary").alias("content"))


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, CASE WHEN l_linenumber % 2 = 0 THEN 'v' ELSE 'vi' END AS o FROM lineitem)
SELECT k AS l_orderkey, string_agg(o, '' ORDER BY n, p, q) AS "order", (2 * count(*))::INTEGER AS n_segments, (sum(4 * p + 2 * 10))::DOUBLE AS x, (sum(4 * q + 2 * n))::DOUBLE AS y, sum(n)::DOUBLE * 2 AS width FROM s GROUP BY 1""")
def page_strokes(spark, sf):
    """Lines there and back in moved coordinates, and images between them."""
    image = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(" /Im0 Do")
    text = _said("q 1 0 0 1 ", F.col("l_partkey"), " ", F.col("l_suppkey"), " cm ", F.col("l_linenumber"), " w 0 0 m 10 ", F.col("l_linenumber"), " l h S Q", image)
    found = _contents(spark, sf, text).select("l_orderkey", P.strokes("content").alias("s"))
    total = lambda i: F.aggregate("s.segments", F.lit(0.0), lambda a, g: a + g["from"][i] + g["to"][i])
    return found.select("l_orderkey", "s.order", F.size("s.segments").alias("n_segments"), total(0).alias("x"), total(1).alias("y"), F.aggregate("s.segments", F.lit(0.0), lambda a, g: a + g["width"]).alias("width"))


@query("""
SELECT l_orderkey, (2 * count(*))::INTEGER AS n_glyphs, (2 * sum(l_partkey + 5))::DOUBLE AS x, sum(65 + l_partkey % 26 + 66)::BIGINT AS codes, (2 * count(*) FILTER (l_linenumber % 3 = 0))::INTEGER AS artifacts, round(sum(2 * (l_linenumber % 2) * 0.5), 3)::DOUBLE AS gray FROM lineitem GROUP BY 1""")
def page_glyphs(spark, sf):
    """Two codes for each line, with places, grays and what they are marked as."""
    code = F.lpad(F.hex(65 + F.col("l_partkey") % 26), 4, "0")
    artifact = F.col("l_linenumber") % 3 == 0
    text = _said(F.when(artifact, "/Artifact BMC ").otherwise(""), F.when(F.col("l_linenumber") % 2 == 1, "0.5").otherwise("0"), " g q 1 0 0 1 5 0 cm BT /F1 12 Tf 1 0 0 1 ", F.col("l_partkey"), " 3 Tm <", code, "0042> Tj ET Q", F.when(artifact, " EMC").otherwise(""))
    found = _contents(spark, sf, text).select("l_orderkey", P.glyphs("content").alias("g"))
    total = lambda f, kind: F.aggregate("g", F.lit(0).cast(kind), lambda a, g: a + f(g))
    return found.select(
        "l_orderkey", F.size("g").alias("n_glyphs"), total(lambda g: g["matrix"][4], "double").alias("x"), total(lambda g: g["code"], "long").alias("codes"),
        F.size(F.filter("g", lambda g: g["role"] == "Artifact")).alias("artifacts"), F.round(total(lambda g: g["gray"], "double"), 3).alias("gray"),
    )


@query("""
WITH p AS (SELECT p_partkey, ['', '0 0 10 10 re', '1 1 2 2 3 3 c', '[<0041> -20 <0042>] TJ', '10 20 Td', 'W', 'ET'][p_partkey % 7 + 1] AS op, ['', 're', 'c', 'TJ', 'Td', 'W', ''][p_partkey % 7 + 1] AS name, p_size AS w FROM part),
l AS (SELECT *, length('q ' || w || ' w 0 0 m 5 5 l S ' || op) - length(name) AS place FROM p)
SELECT p_partkey, CASE WHEN name <> '' THEN 'UNSUPPORTED' WHEN p_partkey % 5 = 0 THEN 'MALFORMED' ELSE 'OK' END AS status, CASE WHEN name <> '' THEN place END::BIGINT AS "offset", CASE WHEN name <> '' THEN name END AS operator, CASE WHEN name = '' AND p_partkey % 5 > 0 THEN 1 END::INTEGER AS segments FROM l""")
def page_statuses(spark, sf):
    """Pages with one operator that is not understood, or with a saved state left: a status with its place, and no rows."""
    odd = F.element_at(F.array(*map(F.lit, ["", "0 0 10 10 re", "1 1 2 2 3 3 c", "[<0041> -20 <0042>] TJ", "10 20 Td", "W", "ET"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    text = _said("q ", F.col("p_size"), " w 0 0 m 5 5 l S ", odd, F.when(F.col("p_partkey") % 5 == 0, "").otherwise(" Q"))
    content = table(spark, sf, "part").select("p_partkey", text.cast("binary").alias("content"))
    found = content.select("p_partkey", P.page_status("content").alias("s"), P.strokes("content").alias("p"))
    return found.select("p_partkey", "s.status", "s.offset", "s.operator", F.when(F.col("p").isNotNull(), F.size("p.segments")).alias("segments"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 9 + p_size % 7 WHEN p_partkey % 4 = 2 THEN 10 + p_size % 7 END::BIGINT AS "offset", CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 END::INTEGER AS arrays, CASE p_partkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 END::INTEGER AS dictionaries FROM part""")
def unfinished_operands(spark, sf):
    """Contents of which half hold a hexadecimal operand without an end, in an array or in a dictionary."""
    gap = F.repeat(F.lit(" "), (F.col("p_size") % 7).cast("int"))
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 1, F.concat(F.lit("[(a<b)<41>"), gap, F.lit("<42 "))).when(kind == 2, F.concat(F.lit("<</A <41>"), gap, F.lit(" <4"))).when(kind == 3, F.lit("(never <42) <41> Tj")).otherwise(F.lit("% <41\n<42> Tj"))
    text = F.when(kind == 1, F.concat(F.lit("[(a<)<41>"), gap, F.lit("<42 "))).otherwise(text)
    return table(spark, sf, "part").select("p_partkey", P.unfinished_hex(text.cast("binary")).alias("u")).select("p_partkey", "u.offset", "u.arrays", "u.dictionaries")


@query("""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey AS p, l_linenumber AS n FROM lineitem), o AS (SELECT k, count(*) AS c FROM l GROUP BY 1)
SELECT o.k AS l_orderkey, l.p * 7::BIGINT AS "offset", l.n::INTEGER AS generation, l.n % 2 = 1 AS in_use FROM o LEFT JOIN l ON l.k = o.k AND l.i = o.k % 5 AND o.k % 5 < o.c""")
def xref_lookups(spark, sf):
    """One object's entry in a table of two sections, if it is there."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    row = F.concat(pad(F.col("l_partkey") * 7, 10), F.lit(" "), pad(F.col("l_linenumber"), 5), F.when(F.col("l_linenumber") % 2 == 1, " n").otherwise(" f"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("t")).alias("r"))
    each = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.concat(r["t"], F.lit(" \n"))).alias("t"))
    section = lambda first, part: F.when(F.size(part) > 0, F.concat(first.cast("string"), F.lit(" "), F.size(part).cast("string"), F.lit("\n"), F.array_join(part, ""))).otherwise("")
    second = F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))
    content = F.concat(F.lit("junk xref\n"), section(F.lit(0), F.slice("t", 1, 2)), section(F.lit(2), second), F.lit("trailer"))
    return each.select("l_orderkey", P.xref_entry(content.cast("binary"), F.lit(5), (F.col("l_orderkey") % 5).cast("long")).alias("e")).select("l_orderkey", "e.offset", "e.generation", "e.in_use")


@query("""
SELECT n_nationkey, unnest(['Im0', 'Im1'][1:1 + n_nationkey % 2]) AS name, unnest([n_nationkey, n_regionkey][1:1 + n_nationkey % 2])::INTEGER AS object, unnest([0, 1][1:1 + n_nationkey % 2])::INTEGER AS generation FROM nation""")
def image_resource_rows(spark, sf):
    """Images that resource dictionaries name."""
    second = F.when(F.col("n_nationkey") % 2 == 1, _said(',"Im1":{"ref":[', F.col("n_regionkey"), ",1]}")).otherwise("")
    text = _said('{"dict":{"Font":{"dict":{}},"XObject":{"dict":{"Im0":{"ref":[', F.col("n_nationkey"), ",0]}", second, "}}}}")
    return table(spark, sf, "nation").select("n_nationkey", F.explode(P.image_resources(text)).alias("i")).select("n_nationkey", "i.*")


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'EXACT' WHEN 3 THEN 'NONE' ELSE 'DIFFERENT' END AS status FROM nation""")
def encryption_profiles(spark, sf):
    """Dictionaries that must have just the entries of one profile."""
    kind = F.col("n_nationkey") % 4
    text = F.when(kind == 0, '{"dict":{"V":4,"Filter":{"name":"Own"}}}').when(kind == 1, '{"dict":{"V":5,"Filter":{"name":"Own"}}}').when(kind == 2, '{"dict":{"V":4,"Filter":{"name":"Own"},"R":1}}')
    return table(spark, sf, "nation").select("n_nationkey", P.profile_of(text, {"V": "4", "Filter": '{"name":"Own"}'}).alias("status"))

"""Whole inspections over controls made of the tables: what a source holds against what an output shows, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import rasters
from quarry.functions.stored import shared_folder, stored
from quarry.operators import experiments as X
from quarry.operators import joins as J
from quarry.operators import status as ST
from quarry.plans.formats import bound_batches
from quarry.sources import archives as Z
from quarry.sources import containers as C
from quarry.sources import generators as G
from quarry.sources import glyph_model as GM
from quarry.sources import images as I
from quarry.sources import layouts as L
from quarry.sources import pdf as PDF
from quarry.sources import pdf_pages as P
from quarry.sources import segments as S
from quarry.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(spark, sf, **columns):
    """For each order its lines in order, as an array ``r`` with ``columns``."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in columns.items()])
    return table(spark, sf, "lineitem").select("l_orderkey", row.alias("r")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r"))


@query("""
SELECT l_orderkey, count(*)::INTEGER AS segments, CASE WHEN l_orderkey % 6 = 1 THEN 1.0 ELSE 0.0 END AS residual, CASE WHEN l_orderkey % 6 = 1 THEN 'FAIL' WHEN l_orderkey % 6 = 2 THEN 'NOT_RUN' ELSE 'PASS' END AS status FROM lineitem GROUP BY 1""")
def run_vector_check(spark, sf):
    """Segments of record streams against strokes of pages; some pages are off by one, some do not exist."""
    p, q = F.col("l_partkey").bitwiseAND(0x3FFF), F.col("l_suppkey").bitwiseAND(0x3FFF)
    record = L.words(0x8006, 0xA385, p, q, F.col("l_linenumber"), F.lit(7))
    off = F.when(F.col("l_orderkey") % 6 == 1, 1).otherwise(0)
    stroke = _said(p + off, " ", q, " m ", F.col("l_linenumber"), " 7 l S")
    orders = _lines(spark, sf, record=record, stroke=stroke)
    stream = F.unhex(F.concat(F.array_join(F.transform("r", lambda r: r["record"]), ""), L.words(L.END, 0)))
    page = F.when(F.col("l_orderkey") % 6 != 2, F.array_join(F.transform("r", lambda r: r["stroke"]), " ").cast("binary"))
    both = orders.select("l_orderkey", L.drawings(stream).alias("s"), P.strokes(page).alias("p"))
    sources = F.transform("s.segments", lambda g: F.array(g["x"], g["y"], g["u"], g["v"]).cast("array<double>"))
    shown = F.transform("p.segments", lambda g: F.concat(g["from"], g["to"]))
    apart = F.array_max(F.zip_with(sources, shown, lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))))
    return both.select("l_orderkey", F.size("s.segments").alias("segments"), F.coalesce(apart, F.lit(0.0)).alias("residual"), ST.verdict(F.col("p").isNotNull(), F.size("s.segments") == F.size("p.segments"), apart <= 0.001).alias("status"))


@query("""
SELECT l_orderkey, count(*)::INTEGER AS images, CASE WHEN l_orderkey % 5 = 3 THEN 'FAIL' ELSE 'PASS' END AS status FROM lineitem GROUP BY 1""")
def run_placement_check(spark, sf):
    """Image boxes of record streams against the matrices that draw them; a fifth of the pages leaves one out."""
    p, q = F.col("l_partkey").bitwiseAND(0x3FFF), F.col("l_suppkey").bitwiseAND(0x3FFF)
    box = F.concat(L.words(L.IMAGE, 0, p, q, F.col("l_quantity").cast("int"), F.col("l_linenumber")), F.lit("0000" * 8))
    drawn = _said("q ", F.col("l_quantity").cast("int"), " 0 0 ", F.col("l_linenumber"), " ", p, " ", q, " cm /Im Do Q")
    orders = _lines(spark, sf, box=box, drawn=drawn)
    stream = F.unhex(F.concat(F.array_join(F.transform("r", lambda r: r["box"]), ""), L.words(L.END, 0)))
    kept = F.when(F.col("l_orderkey") % 5 == 3, F.slice("r", 2, F.size("r"))).otherwise(F.col("r"))
    page = F.array_join(F.transform(kept, lambda r: r["drawn"]), " ").cast("binary")
    both = orders.select("l_orderkey", L.image_boxes()(stream, F.size("r")).alias("b"), PDF.image_draws(page).alias("d"))
    wanted = F.transform("b.boxes", lambda b: F.array(b["width"], F.lit(0), F.lit(0), b["height"], b["x"], b["y"]).cast("array<double>"))
    return both.select("l_orderkey", F.size("b.boxes").alias("images"), ST.verdict(F.col("b.status") == "OK", wanted == F.transform("d", lambda d: d["matrix"])).alias("status"))


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 8 AS k, p_partkey % 4 AS kind FROM part)
SELECT p_partkey, CASE WHEN kind = 0 THEN 0 ELSE 1 END::BIGINT AS changed, CASE WHEN kind = 0 THEN 'EQUAL' WHEN kind = 3 THEN 'INCOMPARABLE' ELSE 'DIFFERENT' END AS outcome FROM b WHERE kind <> 3 UNION ALL SELECT p_partkey, NULL, 'INCOMPARABLE' FROM b WHERE kind = 3""")
def run_raster_measurement(spark, sf):
    """Rasters of pages measured against each other: equal, one sample apart, or of other sizes."""
    a = F.unhex(F.md5(F.col("p_name").cast("binary")))
    kind, at = F.col("p_partkey") % 4, (F.col("p_partkey") % 8).cast("int")
    b = F.when(kind == 0, a).when(kind == 3, F.substring(a, 1, 12)).otherwise(X.lowest_bit_flipped(a, at))
    measured = table(spark, sf, "part").select("p_partkey", I.raster_delta(4)(a, b).alias("d"))
    return measured.select("p_partkey", "d.changed", ST.outcome(F.col("d.changed") == 0, F.col("d").isNotNull(), F.lit(True)).alias("outcome"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' END AS "order", CASE WHEN p_partkey % 3 = 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM part""")
def run_bitmap_verification(spark, sf):
    """One-bit rasters of a source against what the output holds, whatever its row order and spare bits; a third holds something else."""
    key = F.col("p_partkey")
    source = F.unhex(F.concat(F.md5(F.col("p_name").cast("binary")), F.lit("0001")))
    own = F.col("source")
    held = F.when(key % 3 == 0, rasters.padded(own, 13, 2, 1)).when(key % 3 == 1, rasters.padded(rasters.upside_down(own, F.lit(2)), 13, 2, 0)).otherwise(F.unhex(F.md5(F.lit("x").cast("binary"))))
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    spread = parts.repartition(4 * spark.sparkContext.defaultParallelism).select("p_partkey", source.alias("source"))  # a file of few bytes is few tasks
    rows = spread.select("p_partkey", "source", F.sha2(held, 256).alias("held"))
    tried = rows.select("p_partkey", "held", rasters.candidates(F.col("source"), 13, 2).alias("c")).withColumn("found", F.filter("c", lambda c: c["sha256"] == F.col("held")))
    return tried.select("p_partkey", F.get("found", F.lit(0))["order"].alias("order"), F.when(F.size("found") > 0, ST.PASS).otherwise(ST.FAIL).alias("status"))


@query("""
SELECT n_nationkey, 2::BIGINT AS objects, CASE n_nationkey % 4 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS changed, CASE n_nationkey % 4 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS lost, CASE WHEN n_nationkey % 4 IN (1, 2) THEN 'FAIL' ELSE 'PASS' END AS status FROM nation""")
def run_graph_preservation(spark, sf):
    """Objects of documents before and after a conversion: all must be there, with their values and streams."""

    def objects(change, keep):
        text = _said("1 0 obj << /Kind /", F.when(change, "Other").otherwise("Own"), " /Next 2 0 R >> endobj\n", F.when(keep, _said("2 0 obj << /Length 4 >> stream\n", F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), "\nendstream endobj\n")).otherwise(""))
        rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.encode(text, "UTF-8").alias("content"))
        return stored(PDF.read_objects(rows).select("source", "number", "value", "stream_sha256"), "graph")

    kind = F.col("n_nationkey") % 4
    diff = J.full_outer_diff(objects(F.lit(False), F.lit(True)), objects(kind == 1, kind != 2), ["source", "number"], ["value", "stream_sha256"])
    found = diff.groupBy("source").agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("change") == "CHANGED").alias("changed"), F.count_if(F.col("change") == "MISSING").alias("lost"))
    return found.select(F.col("source").cast("long").alias("n_nationkey"), "objects", "changed", "lost", F.when((F.col("changed") == 0) & (F.col("lost") == 0), ST.PASS).otherwise(ST.FAIL).alias("status"))


@query("""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS pages, 0::BIGINT AS differ, 'PASS' AS status FROM documents WHERE doc_id % 10 <> 4 UNION ALL
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT, (len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda x: x = '')))::BIGINT, CASE WHEN replace(text, chr(10), '') = '' THEN 'PASS' ELSE 'FAIL' END FROM documents WHERE doc_id % 10 = 4""")
def run_container_compare(spark, sf):
    """Pages that a container holds against the text it was made of; every tenth text is taken in capitals of another alphabet."""
    bound_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    read = C.read_pages(docs.select(F.col("doc_id").cast("string").alias("source"), G.container_of_lines("text").alias("content")))
    pages = C.good_pages(read).select(F.col("source").cast("long").alias("doc_id"), F.col("page_number").alias("page"), F.coalesce("text_sha256", F.sha2(F.lit(""), 256)).alias("found"))
    line = lambda x: F.when((F.col("doc_id") % 10 == 4) & (x != ""), F.concat(x, F.lit("Ω"))).otherwise(x)
    wanted = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("page"), F.sha2(line(F.col("line")), 256).alias("wanted"))
    both = pages.join(wanted, ["doc_id", "page"], "full").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("found").eqNullSafe(F.col("wanted"))).alias("differ"))
    return both.withColumn("status", F.when(F.col("differ") == 0, ST.PASS).otherwise(ST.FAIL))


@query("""
WITH h AS (SELECT l_linenumber AS file, (l_partkey >> 10) & 3 AS template, (l_partkey >> 1) & 1 AS refinement, l_suppkey AS exported FROM lineitem)
SELECT file, template::INTEGER AS template, refinement::INTEGER AS refinement, count(*)::BIGINT AS n, sum(exported)::BIGINT AS exported, max(exported)::BIGINT AS most FROM h GROUP BY ALL""")
def run_dictionary_inventory(spark, sf):
    """Headers of symbol dictionaries, counted by what their flags say."""
    word = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    header = F.concat(word(F.col("l_partkey").bitwiseAND(0xFFFF), 2), F.unhex(F.lit("03FF")), word(F.col("l_suppkey"), 4), word(F.lit(7), 4))
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("file"), S.dictionary_header(header).alias("h"))
    return rows.groupBy("file", F.col("h.template").alias("template"), F.col("h.refinement_aggregate").alias("refinement")).agg(F.count(F.lit(1)).alias("n"), F.sum("h.exported").alias("exported"), F.max("h.exported").alias("most"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'IDENTICAL' ELSE 'CHANGED' END AS outcome, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % octet_length(encode(p_name)) END::INTEGER AS "at", true AS proved FROM part""")
def run_mutation_probes(spark, sf):
    """Planned one-bit changes, carried out on all but every fourth name, with the proof of what differs."""
    part = table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("a"))
    place = F.pmod("p_partkey", F.octet_length("a")).cast("int")
    probes = part.withColumn("place", place).withColumn("b", F.when(F.col("p_partkey") % 4 == 0, F.col("a")).otherwise(X.lowest_bit_flipped(F.col("a"), F.col("place"))))
    same = F.col("a") == F.col("b")
    return probes.select("p_partkey", F.when(same, "IDENTICAL").otherwise("CHANGED").alias("outcome"), F.when(~same, F.col("place")).alias("at"), F.when(same, True).otherwise(X.changed_once(F.col("a"), F.col("b"), F.col("place"))).alias("proved"))


@query("""
SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'GAP' WHEN conv_id % 5 = 2 THEN 'NO_END' ELSE 'COMPLETE' END AS status, CASE WHEN conv_id % 5 = 2 THEN 0 ELSE count(*) END::INTEGER AS members, CASE WHEN conv_id % 5 = 2 THEN 0 ELSE sum(octet_length(encode(text))) END::BIGINT AS bytes FROM conversations GROUP BY 1""")
def run_archive_inspection(spark, sf):
    """Archives of turns: members proved by their checksums, with bytes that belong to no record, and without an end."""
    bound_batches(spark)
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["turn"].cast("string").alias("name"), F.encode(t["text"], "UTF-8").alias("data"))).alias("t"))
    made = turns.select("conv_id", Z.archived("t").alias("z"))
    kind = F.col("conv_id") % 5
    hurt = F.when(kind == 1, F.concat(F.substring("z", F.lit(1), F.octet_length("z") - 22), F.lit(b"junk"), F.substring("z", F.octet_length("z") - 21, F.lit(22)))).when(kind == 2, F.substring("z", F.lit(1), F.octet_length("z") - 10)).otherwise(F.col("z"))
    read = made.select("conv_id", Z.archive(hurt).alias("a"))
    good = F.filter("a.members", lambda m: m["status"] == "PASS")
    return read.select("conv_id", "a.status", F.size("a.members").alias("members"), F.aggregate(good, F.lit(0).cast("long"), lambda n, m: n + m["size"]).alias("bytes"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'MISSING' WHEN n_nationkey % 5 = 1 THEN 'CHANGED' ELSE 'SAME' END AS change FROM nation UNION ALL SELECT n_nationkey + 100, 'ADDED' FROM nation WHERE n_nationkey % 5 = 0""")
def run_regeneration(spark, sf):
    """A new version out of a predecessor and a candidate: both are sealed, their difference is the new version's receipt."""

    def version(name, rows):
        v = versions.Version(spark, shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
        v.put("items", rows)
        v.seal()
        return versions.read_version(spark, v.path, "items")

    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("pin"))
    kind = F.col("n_nationkey") % 5
    before = version("predecessor", nation)
    changed = nation.withColumns({"pin": F.when(kind == 1, "other").otherwise(F.col("pin")), "n_nationkey": F.when(kind == 0, F.col("n_nationkey") + 100).otherwise(F.col("n_nationkey"))})
    after = version("candidate", changed)
    diff = J.full_outer_diff(before, after, ["n_nationkey"], ["pin"]).select("n_nationkey", "change")
    return version("regenerated", diff)


@query("""
WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_linenumber % 6 AS k, l_partkey & 16383 AS p, l_suppkey & 4095 AS q FROM lineitem),
v AS (SELECT *, last_value(CASE WHEN k = 1 THEN p END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN k = 2 THEN q END IGNORE NULLS) OVER w AS style, last_value(CASE WHEN k = 2 THEN i END IGNORE NULLS) OVER w AS styled,
  last_value(CASE WHEN k = 3 THEN q END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN k = 3 THEN i END IGNORE NULLS) OVER w AS a_at, last_value(CASE WHEN k = 4 THEN 0.225 END IGNORE NULLS) OVER w AS shear, last_value(CASE WHEN k = 5 THEN 0.0 END IGNORE NULLS) OVER w AS gray
  FROM l WINDOW w AS (PARTITION BY o ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT o AS l_orderkey, (i - 1)::INTEGER AS glyph, y::INTEGER AS y, style::INTEGER AS style, CASE WHEN styled IS NULL OR a_at > styled THEN a END::INTEGER AS axis_x, coalesce(shear, 0)::DOUBLE AS shear, CASE WHEN gray IS NULL THEN 68 / 255.0 ELSE 0 END::DOUBLE AS gray, 'OK' AS status FROM v WHERE o % 4 <> 3
UNION ALL SELECT DISTINCT o, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, 'UNKNOWN_RECORD' FROM l WHERE o % 4 = 3""")
def run_glyph_model(spark, sf):
    """Glyphs with the registers that hold for them; a fourth of the streams has an unknown record."""
    p, q = F.col("l_partkey").bitwiseAND(0x3FFF), F.col("l_suppkey").bitwiseAND(0xFFF)
    kind = F.col("l_linenumber") % 6
    control = (
        F.when(kind == 1, L.words(GM.POSITION, p)).when(kind == 2, L.words(GM.STYLE, q)).when(kind == 3, L.words(GM.AXIS_X, q)).when(kind == 4, L.words(GM.SHEAR, 0x281C)).when(kind == 5, L.words(GM.COLOUR, 2, 0, 200))
        .otherwise(L.words(GM.ROLE, 3))
    )
    orders = _lines(spark, sf, record=F.concat(control, L.words(0x1234, p)))
    hurt = F.when(F.col("l_orderkey") % 4 == 3, L.words(0x9999, 0)).otherwise("")
    stream = F.unhex(F.concat(hurt, F.array_join(F.transform("r", lambda r: r["record"]), ""), L.words(L.END, 0)))
    read = orders.select("l_orderkey", GM.glyph_model(stream).alias("m")).select("l_orderkey", "m.status", F.posexplode_outer(F.when(F.col("m.status") == "OK", F.col("m.glyphs"))).alias("glyph", "g"))
    return read.select("l_orderkey", "glyph", "g.y", "g.style", "g.axis_x", "g.shear", "g.gray", "status")

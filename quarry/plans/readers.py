"""Queries of readers, sinks and small functions over controls made of the tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import identity, nested, numbers, texts
from quarry.functions.stored import shared_folder
from quarry.operators import audit as AU
from quarry.operators import rules as R
from quarry.sources import documents as D
from quarry.sources import images as I
from quarry.sources import pdf as P
from quarry.sources import segments as S
from quarry.sources import versions, visitors
from quarry.streaming import events as E

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


def _new_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- nested documents and lines


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 2 THEN 2 END::INTEGER AS pages, CASE WHEN n_nationkey % 3 <> 2 THEN (100 + n_nationkey) * 2 + 30 END::DOUBLE AS extent FROM nation""")
def xml_page_rows(spark, sf):
    """Page boxes of XML listings; a third of them number their pages wrongly."""
    page = lambda n, w, h: _said('<page number="', n, '"><MediaBox l="0" b="5" r="', w, '" t="', h, '"/></page>')
    second = F.when(F.col("n_nationkey") % 3 == 2, 3).otherwise(2)
    text = F.concat(F.lit("<document>"), page(F.lit(1), F.col("n_nationkey") + 100, F.lit(15)), page(second, F.col("n_nationkey") + 100, F.lit(25)), F.lit("</document>"))
    pages = table(spark, sf, "nation").select("n_nationkey", nested.xml_pages(text).alias("p"))
    return pages.select("n_nationkey", F.when(F.col("p").isNotNull(), F.size("p")).alias("pages"), F.aggregate("p", F.lit(0.0), lambda a, p: a + p["width"] + p["height"]).alias("extent"))


@query("""
SELECT n_nationkey, 'READ' AS status, unnest(['a', 'b', 'b']) AS tag, unnest([0, octet_length(encode(n_name)), 1])::INTEGER AS text_bytes FROM nation WHERE n_nationkey % 4 <> 3
UNION ALL SELECT n_nationkey, 'REFUSED', NULL, NULL FROM nation WHERE n_nationkey % 4 = 3""")
def xml_shapes(spark, sf):
    """Tags and text sizes of XML; a document with entities is refused, and has a row that says so."""
    text = F.concat(F.when(F.col("n_nationkey") % 4 == 3, '<!DOCTYPE a [<!ENTITY x "y">]>').otherwise(""), _said("<a><b k='1'>", F.col("n_name"), "</b><b>z</b></a>"))
    shaped = table(spark, sf, "nation").select("n_nationkey", nested.xml_shape(text).alias("shape"))
    status = F.when(F.col("shape").isNull(), "REFUSED").otherwise("READ")
    return shaped.select("n_nationkey", status.alias("status"), F.explode_outer("shape").alias("s")).select("n_nationkey", "status", "s.tag", "s.text_bytes")


@query("""
WITH n AS (SELECT n_regionkey AS r, n_name AS title, n_nationkey AS page, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)
SELECT r AS n_regionkey, i::INTEGER AS ordinal, 1::INTEGER AS depth, title, page::INTEGER AS page FROM n UNION ALL SELECT DISTINCT r, 0, 0, 'Region ' || r, NULL FROM n""")
def outlines_in_preorder(spark, sf):
    """Outlines as trees, flattened in pre-order with depths."""
    kids = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("title"), F.col("n_nationkey").cast("int").alias("page")))).alias("kids"))
    tree = F.to_json(F.array(F.struct(_said("Region ", F.col("n_regionkey")).alias("title"), F.col("kids").alias("kids"))))
    return kids.select("n_regionkey", F.explode(nested.preorder(tree)).alias("o")).select("n_regionkey", "o.ordinal", "o.depth", "o.title", "o.page")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey % 3 ELSE 0 END::INTEGER AS depth, CASE WHEN n_nationkey % 5 <> 4 THEN n_name || ' "x"' END AS title, CASE WHEN n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0 THEN n_nationkey END::INTEGER AS page FROM nation""")
def outline_listings(spark, sf):
    """Outline lines with depths, quoted titles and destinations; a fifth of another form."""
    key = F.col("n_nationkey")
    target = F.when(key % 2 == 0, _said("#page=", key, "&zoom=1")).otherwise("http://x")
    line = F.when(key % 5 == 4, "no outline").otherwise(F.concat(F.lit("|"), F.repeat(F.lit("\t"), (key % 3).cast("int")), _said('"', F.col("n_name"), ' \\"x\\""\t'), target))
    return table(spark, sf, "nation").select("n_nationkey", D.outline_lines(line)[0].alias("o")).select("n_nationkey", "o.depth", "o.title", "o.page")


@query("""
SELECT n_regionkey AS region, NULL::VARCHAR AS fault, n_name AS name, n_nationkey::INTEGER AS key FROM nation WHERE n_regionkey % 4 <> 3
UNION ALL SELECT r_regionkey, 'NOT_JSON', NULL, NULL FROM region WHERE r_regionkey % 4 = 3""")
def json_documents(spark, sf):
    """Whole JSON files, exploded; a file that repeats a key is no strict JSON, and has a row that says so."""
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("key")))).alias("samples"))
    again = F.when(F.col("n_regionkey") % 4 == 3, ',"samples":[]').otherwise("")
    path = _new_path(spark, "documents")
    rows.select("n_regionkey", _said('{"region":', F.col("n_regionkey"), ',"samples":', F.col("samples"), again, "}").alias("value")).write.partitionBy("n_regionkey").text(path)
    read = D.read_document(spark, path, "region int, samples array<struct<name: string, key: int>>")
    region = F.coalesce(F.col("document.region").cast("long"), F.regexp_extract("source", r"n_regionkey=(\d+)", 1).cast("long"))
    return read.select(region.alias("region"), "fault", F.explode_outer("document.samples").alias("s")).select("region", "fault", "s.name", "s.key")


@query("""
SELECT event_id, event_type, event_id % 10 <> 7 AS well_formed FROM (SELECT event_id, CASE WHEN event_id % 10 <> 7 THEN event_type END AS event_type FROM events)""")
def event_traces(spark, sf):
    """Tab-separated logs as typed rows; a tenth of the lines have a field too many, and markers are no events."""
    path = _new_path(spark, "trace")
    line = _said(F.col("event_id"), "\t", F.col("event_type"), F.when(F.col("event_id") % 10 == 7, "\tx").otherwise(""))
    lines = table(spark, sf, "events").select(line.alias("value"))
    lines.unionByName(spark.range(3).select(F.lit("LIMIT_EVENTS").alias("value"))).write.text(path)
    raw = spark.read.text(path).where("value != 'LIMIT_EVENTS'").select(F.split("value", "\t")[0].cast("long").alias("event_id"))
    rows, _ = D.read_trace(spark, path, "event_id long, event_type string")
    good = rows.where("well_formed").select("event_id", "event_type", "well_formed")
    bad = raw.join(good, "event_id", "left_anti").select("event_id", F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("well_formed"))
    return good.unionByName(bad)


# ---------------------------------------------------------------- identities, names and numbers


@query("""
WITH p AS (SELECT p_partkey, upper(hex(encode(p_name))) AS h, octet_length(encode(p_name)) AS n, p_partkey % 7 AS a, p_size % 9 AS l FROM part)
SELECT p_partkey, CASE WHEN a + l <= n THEN sha256(unhex(h[2 * a + 1:2 * (a + l)])) END AS sha256 FROM p""")
def range_identities(spark, sf):
    """Hashes of byte ranges that are inside."""
    a, n = (F.col("p_partkey") % 7).cast("int"), (F.col("p_size") % 9).cast("int")
    return table(spark, sf, "part").select("p_partkey", identity.range_sha256(F.encode("p_name", "UTF-8"), a, n).alias("sha256"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN 'A ' || p_type || '#' || chr((65 + p_partkey % 26)::INTEGER) END AS name FROM part""")
def escaped_names(spark, sf):
    """Names with escapes; a sixth of them has a bad one."""
    code = F.lpad(F.hex(65 + F.col("p_partkey") % 26), 2, "0")
    raw = F.concat(F.lit("A#20"), F.col("p_type"), F.lit("#23#"), F.when(F.col("p_partkey") % 6 == 5, "g1").otherwise(code))
    return table(spark, sf, "part").select("p_partkey", texts.decode_name(raw).alias("name"))


@query("""
SELECT conv_id, turn, nfc_normalize(text) AS text FROM conversations""")
def normal_forms(spark, sf):
    """Texts with decomposed letters and carriage returns, in their normal form."""
    broken = F.concat(F.col("text"), F.lit("e\u0301\r\nx\ry"))
    found = texts.normal_form(broken)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.endswith(found, F.lit("\u00e9\nx\ny")), F.substring(found, F.lit(1), F.char_length(found) - 5)).alias("text"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey & 65535)::INTEGER AS first, (l_suppkey & 65535)::INTEGER AS second, (2 * l_linenumber)::DOUBLE AS a, (l_partkey * 3 + l_suppkey)::DOUBLE AS e, abs(l_quantity::DOUBLE - 25) <= 5 AS near FROM lineitem""")
def number_readings(spark, sf):
    """Little-endian words, products of affine maps and numbers within a tolerance."""
    word = lambda c: F.concat(F.substring(F.lpad(F.hex(c.bitwiseAND(0xFFFF)), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c.bitwiseAND(0xFFFF)), 4, "0"), 1, 2))
    pair = numbers.little_endian_words(F.unhex(F.concat(F.lit("00"), word(F.col("l_partkey")), word(F.col("l_suppkey")))), 1, 2)
    double = lambda *v: F.array(*[(F.lit(x) if isinstance(x, int) else x).cast("double") for x in v])
    product = numbers.multiply(double(F.col("l_linenumber"), 0, 0, 1, F.col("l_partkey"), 0), double(2, 0, 0, 1, 0, 0))
    moved = numbers.multiply(double(1, 0, 0, 1, F.col("l_partkey"), 0), double(3, 0, 0, 1, F.col("l_suppkey"), 0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pair[0].alias("first"), pair[1].alias("second"), product[0].alias("a"), moved[4].alias("e"), numbers.close(F.col("l_quantity").cast("double"), F.lit(25.0), 5).alias("near"))


@query("""
SELECT n_nationkey, n_nationkey % 3 <> 1 AS exact, n_nationkey % 2 = 0 AS allowed FROM nation""")
def key_sets(spark, sf):
    """Maps that must have just some keys, and changes that may touch just some."""
    extra = F.when(F.col("n_nationkey") % 3 == 1, F.map_concat(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("c"), F.lit(3)))).otherwise(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))
    changed = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Parent"))).otherwise(F.array(F.lit("Parent"), F.lit("Kids")))
    return table(spark, sf, "nation").select("n_nationkey", R.exact_keys(extra, ["a", "b"]).alias("exact"), R.allowed_changes(changed, ["Parent"]).alias("allowed"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 1000 AS v, lag(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN v >= b THEN v - b END AS delta FROM o""")
def counter_deltas(spark, sf):
    """Steps of counters that are reset now and then."""
    value = F.col("o_orderkey") % 1000
    before = F.lag(value).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", value.alias("v"), before.alias("b")).select("o_custkey", "o_orderkey", AU.counter_delta(F.col("b"), F.col("v")).alias("delta"))


# ---------------------------------------------------------------- portable documents and images


def _portable(spark, sf):
    """A document of two objects for each nation; every second one refers to a third that it lacks."""
    third = F.when(F.col("n_nationkey") % 2 == 1, " /Lost 3 0 R").otherwise("")
    text = _said("%PDF-1.4\n1 0 obj << /Type /Catalog /Next 2 0 R", third, " >> endobj\n2 0 obj << /Length ", F.octet_length("n_name"), " >> stream\n", F.col("n_name"), "\nendstream endobj\n")
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.encode(text, "UTF-8").alias("content"))


@query("""
SELECT n_nationkey, 1::BIGINT AS number, 'value' AS kind, NULL::BIGINT AS stream_bytes, NULL AS stream_sha256, (1 + n_nationkey % 2)::INTEGER AS refs FROM nation
UNION ALL SELECT n_nationkey, 2, 'stream', octet_length(encode(n_name)), sha256(n_name), 0 FROM nation""")
def portable_objects(spark, sf):
    """Objects with their streams and references."""
    rows = P.read_objects(_portable(spark, sf)).where("fault IS NULL")
    return rows.select(F.col("source").cast("long").alias("n_nationkey"), "number", "kind", "stream_bytes", "stream_sha256", F.size("refs").alias("refs"))


@query("""
SELECT n_nationkey, 1::BIGINT AS owner, 3::BIGINT AS number, '$.Lost' AS path FROM nation WHERE n_nationkey % 2 = 1""")
def portable_dangling(spark, sf):
    """References to objects that a document lacks."""
    from quarry.functions.stored import stored

    rows = stored(P.read_objects(_portable(spark, sf)), "objects")
    return P.dangling(rows).select(F.col("source").cast("long").alias("n_nationkey"), "owner", "number", "path")


@query("""
SELECT p_partkey, i::INTEGER AS ordinal, 'Im' || i AS name, (2 * (i + 1))::DOUBLE AS a, (p_size * 2 + p_partkey)::DOUBLE AS e FROM part, (SELECT unnest(range(2)) AS i)""")
def drawn_images(spark, sf):
    """Images of page contents with the matrix in force."""
    one = lambda i: _said("q ", F.lit(i + 1), " 0 0 1 ", F.col("p_size"), " 0 cm /Im", F.lit(i), " Do Q ")
    content = F.concat(_said("2 0 0 1 ", F.col("p_partkey"), " 0 cm "), one(0), one(1)).cast("binary")
    return table(spark, sf, "part").select("p_partkey", F.explode(P.image_draws(content)).alias("d")).select("p_partkey", "d.ordinal", "d.name", F.col("d.matrix")[0].alias("a"), F.col("d.matrix")[4].alias("e"))


@query("""
SELECT n_nationkey, n_name || 'Z' AS shown FROM nation""")
def shown_texts(spark, sf):
    """Text that is shown, without artifacts and with actual text in place of what it covers."""
    hexed = lambda c: F.hex(F.encode(c, "UTF-16BE"))
    content = _said("1 0 0 1 0 0 Tm <", hexed(F.col("n_name")), "> Tj /Artifact BMC Tm <0041> Tj EMC /Span << /ActualText <FEFF005A> >> BDC Tm <0042> Tj EMC")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(P.shown_text(content), "").alias("shown"))


@query("""
SELECT n_nationkey, (n_nationkey + unnest([0, 1, 10, 11, 12]))::INTEGER AS code, unnest([500, 600, 300, 300, 300])::DOUBLE AS width FROM nation""")
def font_widths(spark, sf):
    """Width arrays of fonts, both forms."""
    key = F.col("n_nationkey")
    return P.width_rows(table(spark, sf, "nation").withColumn("w", _said("[", key, ",[500,600],", key + 10, ",", key + 12, ",300]")), ["n_nationkey"], "w")


@query("""
SELECT r_regionkey, r_regionkey % 3 = 0 AS identity FROM region""")
def identity_maps(spark, sf):
    """Code maps that must lead every code to itself; some have a gap or another target."""
    part = lambda a, b, t: F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), t.alias("target"))
    key = F.col("r_regionkey") % 3
    first = F.when(key == 1, F.lit(257)).otherwise(F.lit(256))
    rows = table(spark, sf, "region").select("r_regionkey", F.explode(F.array(part(0, 255, F.lit(0)), F.struct(first.alias("first"), F.lit(0xD7FF).alias("last"), F.when(key == 2, 1).otherwise(first).alias("target")), part(0xE000, 0xFFFF, F.lit(0xE000)))).alias("i"))
    return P.identity_tiling(rows.select("r_regionkey", "i.*"), ["r_regionkey"])


@query("""
WITH p AS (SELECT p_partkey, md5(p_name) AS h FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 3 THEN 'P4' END AS kind, CASE WHEN p_partkey % 5 <> 3 THEN 13 END::INTEGER AS width, CASE WHEN p_partkey % 5 <> 3 THEN 8 END::INTEGER AS height, CASE WHEN p_partkey % 5 <> 3 THEN sha256(unhex(h)) END AS sha256 FROM p""")
def bitmap_headers(spark, sf):
    """Raw bitmaps with comments in their headers; a fifth lacks its last byte."""
    pixels = F.unhex(F.md5(F.col("p_name").cast("binary")))
    image = F.concat(F.lit(b"P4\n# made of a name\n13 8\n"), F.when(F.col("p_partkey") % 5 == 3, F.substring(pixels, 1, 15)).otherwise(pixels))
    return table(spark, sf, "part").select("p_partkey", I.pnm(image).alias("i")).select("p_partkey", "i.kind", "i.width", "i.height", F.sha2("i.pixels", 256).alias("sha256"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS width, l_suppkey AS height, (l_linenumber % 2)::INTEGER AS refinement, l_linenumber % 3 = 0 AS anomalous, l_quantity::BIGINT AS instances FROM lineitem""")
def text_regions(spark, sf):
    """Headers of text regions."""
    word = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    flags = F.when(F.col("l_linenumber") % 3 == 0, 0x8000).otherwise(0) + F.col("l_linenumber") % 2 * 2
    data = F.unhex(F.concat(word(F.col("l_partkey"), 4), word(F.col("l_suppkey"), 4), word(F.lit(0), 8), F.lit("00"), word(flags, 2), word(F.col("l_quantity").cast("long"), 4), F.lit("0000")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.text_header(data).alias("h")).select("l_orderkey", "l_linenumber", "l_partkey", "h.width", "h.height", "h.refinement", "h.anomalous", "h.instances")


# ---------------------------------------------------------------- streams, table functions and sinks


@query("""
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.ts < b.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""")
def streamed_pairs(spark, sf):
    """Clicks and purchases correlated as streams, run to their end."""
    source, path = _new_path(spark, "events"), _new_path(spark, "pairs")
    table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    pairs = E.correlate(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "ts", "2 hours", "365 days")
    out = pairs.select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase"))
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("""
SELECT n_nationkey, unnest(range(9))::INTEGER AS ordinal, unnest(['word', 'name', 'number', 'word', 'mark', 'string', 'mark', 'word', 'word']) AS kind FROM nation""")
def page_tokens(spark, sf):
    """Tokens of page contents by a table function."""
    visitors.register(spark)
    content = _said("BT /F1 ", F.col("n_nationkey"), " Tf [(a)] TJ ET")
    table(spark, sf, "nation").select("n_nationkey", F.encode(content, "UTF-8").alias("c")).createOrReplaceTempView("quarry_page_tokens")
    return spark.sql("SELECT n_nationkey, t.ordinal, t.kind FROM quarry_page_tokens, LATERAL token_rows(c) AS t(ordinal, kind, value)")


@query("""
SELECT conv_id, turn, (length(text) + 1)::BIGINT AS rows, 'TERMINATOR' AS ended FROM conversations""")
def visited_records(spark, sf):
    """Glyph records by a table function, a row for each and one that says how the stream ended."""
    from quarry.sources import generators as G

    visitors.register(spark)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text").repartition(4 * spark.sparkContext.defaultParallelism)  # a file of few bytes is few tasks
    turns.select("conv_id", "turn", G.glyph_stream_of("text").alias("d")).createOrReplaceTempView("quarry_visited_records")
    rows = spark.sql("SELECT conv_id, turn, g.kind FROM quarry_visited_records, LATERAL glyph_rows(d, 1000000) AS g(kind, offset, x, y, code)")
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("kind") != "glyph", F.col("kind"))).alias("ended"))


@query("""
SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def sealed_versions(spark, sf):
    """A version that is written once, sealed and read back."""
    version = versions.Version(spark, shared_folder(spark), f"version-{uuid.uuid4().hex}")
    version.put("nation", table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    version.seal()
    return versions.read_version(spark, version.path, "nation")

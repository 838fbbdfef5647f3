"""Queries over controls made of the tables: record layouts, rasters, experiments and proofs, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import nested, rasters
from quarry.operators import experiments as X
from quarry.operators import models as M
from quarry.operators import proofs as P
from quarry.sources import layouts as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- record layouts


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 AS k, 12 + 16 * l_quantity::BIGINT + 28 * (l_linenumber % 4) + CASE WHEN l_partkey % 3 = 0 THEN 4 ELSE 0 END AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n - 12 - 28 * k >= 0 AND (n - 12 - 28 * k) % 16 = 0 THEN (n - 12 - 28 * k) // 16 END AS glyphs FROM c""")
def layout_counts(spark, sf):
    """Glyph records inferred from decoded lengths; a third of the lengths fit no layout."""
    images = F.col("l_linenumber") % 4
    size = 12 + 16 * F.col("l_quantity").cast("long") + 28 * images + F.when(F.col("l_partkey") % 3 == 0, 4).otherwise(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.glyph_records(size, images).alias("glyphs"))


def _lines(spark, sf, record):
    """For each order its lines' records in order, as hexadecimal digits, and their number."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", record.alias("hex")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["hex"]), "").alias("hex"), F.count(F.lit(1)).cast("int").alias("images"))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_partkey & 16383 AS x, l_suppkey & 16383 AS y, l_quantity::INTEGER AS w, l_linenumber AS h FROM lineitem)
SELECT k AS l_orderkey, ['direct', 'raw', 'tagged'][k % 3 + 1] AS framing, CASE WHEN k % 7 = 6 THEN CASE WHEN k % 3 = 2 THEN 'NO_LAYOUT' ELSE 'UNKNOWN_RECORD' END ELSE 'OK' END AS status,
  (CASE WHEN k % 7 = 6 THEN 0 ELSE count(*) END)::INTEGER AS n_boxes, (CASE WHEN k % 7 = 6 THEN 0 ELSE sum(x - 100) END)::BIGINT AS x, (CASE WHEN k % 7 = 6 THEN 0 ELSE sum(y - 50) END)::BIGINT AS y,
  (CASE WHEN k % 7 = 6 THEN 0 ELSE sum(w) END)::BIGINT AS width, (CASE WHEN k % 7 = 6 THEN 0 ELSE sum(h) END)::BIGINT AS height FROM b GROUP BY k""")
def image_boxes(spark, sf):
    """Image boxes of raw, packed and fixed streams, from an origin; every seventh stream is damaged."""
    key, flagged = F.col("l_orderkey"), (F.col("l_orderkey") % 2 == 0) & (F.col("l_orderkey") % 3 != 0)
    high = F.when(flagged, L.HIGH).otherwise(0)
    box = L.words(L.IMAGE, F.when(flagged, L.FLAGGED).otherwise(0), F.col("l_partkey").bitwiseAND(0x3FFF).bitwiseOR(high), F.col("l_suppkey").bitwiseAND(0x3FFF), F.col("l_quantity").cast("int").bitwiseOR(high), F.col("l_linenumber"))
    streams = _lines(spark, sf, F.concat(box, F.lit("0000" * 8)))
    hurt, end = key % 7 == 6, L.words(L.END, 0)
    slots = F.unhex(F.concat(L.words(0x801D, 0, 7, 65), F.when(hurt, L.words(0x9999, 0)).otherwise(F.lit("")), F.col("hex"), end))
    fixed = F.unhex(F.concat(L.words(0x801C, 0, 0x80CE, 0), F.repeat(F.lit("00" * 16), (key % 5).cast("int")), F.when(hurt, "0000").otherwise(F.lit("")), F.col("hex"), end))
    packed = lambda data: F.concat(F.lit(L.PACKED), F.unhex(F.concat(L.words(F.octet_length(data)), F.lit("0000"))), L.deflated(data))
    data = F.when(key % 3 == 0, packed(slots)).when(key % 3 == 1, slots).otherwise(F.concat(F.unhex(L.words(0x8003, 800, 0x8003, 600)), packed(fixed)))
    read = streams.select("l_orderkey", L.image_boxes()(data, "images").alias("b")).withColumn("boxes", L.relative(F.col("b.boxes"), F.lit(100), F.lit(50)))
    total = lambda f: F.aggregate("boxes", F.lit(0).cast("long"), lambda a, b: a + b[f]).alias(f)
    return read.select("l_orderkey", "b.framing", "b.status", F.size("boxes").alias("n_boxes"), total("x"), total("y"), total("width"), total("height"))


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, l_quantity AS z, CASE WHEN l_linenumber % 3 = 1 THEN 'gv' WHEN l_linenumber % 3 = 2 THEN 'i' ELSE 'v' END AS o, l_linenumber % 3 <> 2 AS seg FROM lineitem)
SELECT k AS l_orderkey, string_agg(o, '' ORDER BY n, p, q, z) AS "order", (count(*) FILTER (seg))::INTEGER AS n_segments, coalesce(sum((p & 16383) + (q & 16383)) FILTER (seg), 0)::BIGINT AS first, coalesce(sum(z::INTEGER) FILTER (seg), 0)::BIGINT AS second FROM s GROUP BY k""")
def drawn_segments(spark, sf):
    """Segments of record streams and the order in which things are painted."""
    p, q = F.col("l_partkey").bitwiseAND(0x3FFF), F.col("l_suppkey").bitwiseAND(0x3FFF)
    segment = L.words(0x8006, 0xA385, p, q, F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    image = F.concat(L.words(L.IMAGE, 0, 1, 1, 5, 5), F.lit("0000" * 8))
    kind = F.col("l_linenumber") % 3
    streams = _lines(spark, sf, F.when(kind == 1, F.concat(L.words(0x0041, 0x2020), segment)).when(kind == 2, image).otherwise(segment))
    read = streams.select("l_orderkey", L.drawings(F.unhex(F.concat("hex", L.words(L.END, 0)))).alias("d"))
    total = lambda a, b: F.aggregate("d.segments", F.lit(0).cast("long"), lambda s, g: s + g[a] + (g[b] if b else 0))
    return read.select("l_orderkey", "d.order", F.size("d.segments").alias("n_segments"), total("x", "y").alias("first"), total("u", None).alias("second"))


# ---------------------------------------------------------------- rasters

_RASTER = "SELECT p_partkey, md5(p_name) AS h FROM part"


@query(f"""
WITH p AS ({_RASTER}), r AS (SELECT p_partkey, list_transform(range(8), lambda i: upper(h[4 * i + 1:4 * i + 4])) AS r FROM p),
o AS (SELECT p_partkey, 'top' AS "order", r FROM r UNION ALL SELECT p_partkey, 'bottom', list_reverse(r) FROM r),
f AS (SELECT p_partkey, "order", pad, array_to_string(list_transform(r, lambda x: x[1:2] || printf('%02X', CASE WHEN pad = 1 THEN ('0x' || x[3:4])::INTEGER | 7 ELSE ('0x' || x[3:4])::INTEGER & 248 END)), '') AS h FROM o, (SELECT unnest([0, 1]) AS pad))
SELECT p_partkey, "order", pad::INTEGER AS pad, list_sum(list_transform(range(16), lambda i: bit_count(('0x' || h[2 * i + 1:2 * i + 2])::INTEGER)))::INTEGER AS ones, sha256(unhex(h)) AS sha256 FROM f""")
def bitmap_candidates(spark, sf):
    """One-bit rasters of 13 by 8: both row orders and both fillings of the spare bits."""
    bits = table(spark, sf, "part").select("p_partkey", F.unhex(F.md5(F.col("p_name").cast("binary"))).alias("d"))
    return bits.select("p_partkey", F.explode(rasters.candidates(F.col("d"), 13, 2)).alias("c")).select("p_partkey", "c.*")


@query(f"""
WITH p AS ({_RASTER}), c AS (SELECT p_partkey, p_partkey % 4 AS l, p_partkey % 3 AS t, upper(h) AS h FROM p)
SELECT p_partkey, CASE WHEN l + 2 <= 4 AND t + 2 <= 4 THEN h[2 * (t * 4 + l) + 1:2 * (t * 4 + l) + 4] || h[2 * ((t + 1) * 4 + l) + 1:2 * ((t + 1) * 4 + l) + 4] END AS cut,
  len(list_filter(range(16), lambda i: h[2 * i + 1:2 * i + 2] <> '00'))::INTEGER AS inked FROM c""")
def cropped_rasters(spark, sf):
    """A square of two bytes by two rows out of four by four, where it is inside, and how many bytes are not 0."""
    d = table(spark, sf, "part").select("p_partkey", F.unhex(F.md5(F.col("p_name").cast("binary"))).alias("d"))
    left, top = (F.col("p_partkey") % 4).cast("int"), (F.col("p_partkey") % 3).cast("int")
    cut = rasters.crop(F.col("d"), F.lit(4), left, top, F.lit(2), F.lit(2))
    return d.select("p_partkey", F.hex(cut).alias("cut"), rasters.other_bytes(F.col("d"), 0).alias("inked"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 6 AS l, p_size % 4 AS t, p_size % 6 + 2 AS r, p_size % 4 + 3 AS b FROM part)
SELECT p_partkey, array_to_string(list_transform(range(48), lambda i: CASE WHEN i % 8 >= l AND i % 8 < r AND i // 8 >= t AND i // 8 < b THEN '01' ELSE '00' END), '') AS grid FROM p""")
def rectangle_grids(spark, sf):
    """Rectangles drawn on grids of eight by six."""
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.hex(rasters.filled_grid(size % 6, size % 4, size % 6 + 2, size % 4 + 3, 8, 6)).alias("grid"))


@query("""
WITH p AS (SELECT p_partkey, upper(hex(encode(p_name))) AS h, octet_length(encode(p_name)) AS n, p_partkey % (octet_length(encode(p_name)) + 1) AS k FROM part)
SELECT p_partkey, CASE WHEN k < n THEN k END::INTEGER AS prefix, CASE WHEN k < n THEN n - k END::INTEGER AS suffix FROM p""")
def zero_suffixes(spark, sf):
    """Names whose ends were overwritten with zeros: where that begins, if it does."""
    part = table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("a"))
    kept = (F.col("p_partkey") % (F.octet_length("a") + 1)).cast("int")
    damaged = F.concat(F.substring("a", F.lit(1), kept), F.unhex(F.repeat(F.lit("00"), F.octet_length("a") - kept)))
    return part.select("p_partkey", rasters.zero_suffix(F.col("a"), damaged).alias("z")).select("p_partkey", "z.prefix", "z.suffix")


@query("""
WITH s AS (SELECT s_suppkey, md5(s_name)[1:12] AS h FROM supplier), w AS (SELECT *, unnest([2, 4]) AS w FROM s), a AS (SELECT *, unnest(range(7 - w)) AS a FROM w), o AS (SELECT *, unnest(['little', 'big']) AS o FROM a),
v AS (SELECT *, ('0x' || array_to_string(list_transform(range(w), lambda i: CASE WHEN o = 'big' THEN h[2 * (a + i) + 1:2 * (a + i) + 2] ELSE h[2 * (a + w - 1 - i) + 1:2 * (a + w - 1 - i) + 2] END), ''))::BIGINT AS v FROM o),
g AS (SELECT *, unnest([false, true]) AS g FROM v)
SELECT s_suppkey, a::INTEGER AS "at", w::INTEGER AS width, o AS "order", g AS signed, (CASE WHEN g AND v >= (1::BIGINT << (8 * w - 1)) THEN v - (1::BIGINT << (8 * w)) ELSE v END)::BIGINT AS value FROM g""")
def numeric_readings(spark, sf):
    """All integers of two and four bytes that six bytes can be read as."""
    data = F.unhex(F.substring(F.md5(F.col("s_name").cast("binary")), 1, 12))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(rasters.numeric_candidates(data)).alias("c")).select("s_suppkey", "c.*")


# ---------------------------------------------------------------- experiments


@query("""
WITH t AS (SELECT l_returnflag AS f, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1)
SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(abs(i + s * l_quantity - l_extendedprice)), 3) AS mean_error, round(max(abs(i + s * l_quantity - l_extendedprice)), 3)::DOUBLE AS max_error FROM lineitem JOIN t ON f = l_returnflag WHERE l_linenumber = 1 GROUP BY 1""")
def affine_predictions(spark, sf):
    """A fit on all lines but the first of each order, held against the first ones."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("y"))
    fitted = M.affine_fit(lines.where("l_linenumber != 1"), "l_returnflag", ["q"], "y").select("l_returnflag", "coefficients")
    error = F.abs(X.predicted(F.col("coefficients"), [F.col("q")]) - F.col("y"))
    return lines.where("l_linenumber = 1").join(fitted, "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 3).alias("mean_error"), F.round(F.max(error), 3).alias("max_error"))


@query("""
WITH h AS (SELECT o_orderpriority AS p, CASE WHEN o_orderkey % 4 <> 0 THEN 'TRAIN' ELSE 'VALIDATE' END AS role, o_orderkey AS k, unnest(['flat', 'by_customer']) AS hypothesis, unnest([abs(150000 - o_totalprice), abs(o_custkey * 100.0 - o_totalprice)]) AS e FROM orders)
SELECT p AS o_orderpriority, role, hypothesis, count(*)::BIGINT AS rows, count(*) FILTER (e <= 50000)::BIGINT AS matches, round(max(e), 2)::DOUBLE AS max_error, array_to_string((list(k ORDER BY k) FILTER (e > 50000))[1:5], ',') AS counterexamples FROM h GROUP BY ALL""")
def hypotheses_apart(spark, sf):
    """Hypotheses on rows to learn from and rows kept apart, with the first that do not match."""
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice").cast("double")
    found = X.evaluated(orders, ["o_orderpriority"], F.col("o_orderkey") % 4 != 0, {"flat": F.lit(150000.0), "by_customer": F.col("o_custkey") * 100.0}, price, 50000, "o_orderkey")
    return found.withColumns({"max_error": F.round("max_error", 2), "counterexamples": F.array_join("counterexamples", ",")})


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), f AS (SELECT doc_id, n, unnest(['head', 'middle', 'tail']) AS field, unnest([0, n // 2, n - 3]) AS p, unnest([2, 4, 4]) AS w FROM d)
SELECT doc_id, field, p::BIGINT AS "at", w::INTEGER AS width FROM f WHERE p >= 0 AND p + w <= n""")
def planned_mutations(spark, sf):
    """Byte fields of every text that a mutation may change; those that stick out are no candidates."""
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return X.planned(docs, ["doc_id"], {"head": (F.lit(0), 2), "middle": (F.floor(F.col("n") / 2), 4), "tail": (F.col("n") - 3, 4)}, F.col("n"))


@query("""
WITH p AS (SELECT p_partkey, upper(hex(encode(p_name))) AS h, p_partkey % octet_length(encode(p_name)) AS k FROM part)
SELECT p_partkey, k::INTEGER AS "at", sha256(unhex(h[1:2 * k] || printf('%02X', xor(('0x' || h[2 * k + 1:2 * k + 2])::INTEGER, 1)) || h[2 * k + 3:])) AS sha256, true AS proved FROM p""")
def flipped_fields(spark, sf):
    """The lowest bit of one byte of each name is turned, and exactly that byte differs."""
    part = table(spark, sf, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("a"))
    part = part.withColumn("at", F.pmod("p_partkey", F.octet_length("a")).cast("int")).withColumn("b", X.lowest_bit_flipped(F.col("a"), F.col("at")))
    return part.select("p_partkey", "at", F.sha2("b", 256).alias("sha256"), X.changed_once(F.col("a"), F.col("b"), F.col("at")).alias("proved"))


@query("""
WITH p AS (SELECT p_partkey // 2 AS pair, p_partkey % 2 AS side, upper(hex(encode(p_name))) AS h FROM part), j AS (SELECT a.pair, a.h AS a, b.h AS b FROM p a JOIN p b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)
SELECT pair, CASE WHEN length(b) >= 16 AND length(a) >= 16 THEN sha256(unhex(a[1:8] || b[9:16] || a[17:])) END AS transplant,
  CASE WHEN pair % 3 <> 0 AND length(a) >= 6 THEN sha256(unhex('2A2A2A' || a[7:])) END AS content FROM j""")
def transplants(spark, sf):
    """A component of one name put into another, and content replaced where it is what was declared."""
    part = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 2).alias("pair"), (F.col("p_partkey") % 2).alias("side"), F.encode("p_name", "UTF-8").alias("d"))
    both = part.where("side = 0").select("pair", F.col("d").alias("a")).join(part.where("side = 1").select("pair", F.col("d").alias("b")), "pair")
    declared = F.when(F.col("pair") % 3 != 0, F.sha2(F.substring("a", 1, 3), 256)).otherwise("something else")
    return both.select("pair", F.sha2(X.transplanted(F.col("a"), F.col("b"), F.lit(4), F.lit(4)), 256).alias("transplant"), F.sha2(X.content_replaced(F.col("a"), F.lit(b"***"), F.lit(0), declared), 256).alias("content"))


@query("""
WITH b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS o FROM lineitem),
c AS (SELECT k, count(*) AS n, max(o) AS last FROM b GROUP BY 1)
SELECT k AS l_orderkey, n::BIGINT AS n, CASE k % 5 WHEN 1 THEN 'PAGE_OR_DRAW_COUNT_CHANGED' WHEN 2 THEN 'IMAGE_DIMENSIONS_CHANGED' WHEN 3 THEN CASE WHEN last > 0 THEN 'EXTRA_IMAGE_TRANSLATION_CHANGED' ELSE 'NO_GEOMETRY_CHANGE' END WHEN 4 THEN 'OTHER_GEOMETRY_CHANGE' ELSE 'NO_GEOMETRY_CHANGE' END AS outcome FROM c""")
def geometry_outcomes(spark, sf):
    """Drawings of each order before and after a change: a drawing gone, resized, the later ones or all moved, or none."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    before = table(spark, sf, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("draw"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").cast("int").alias("w"))
    kind, later = F.col("l_orderkey") % 5, F.col("draw") > 0
    moved = F.when((kind == 4) | ((kind == 3) & later), 1).otherwise(0)
    after = before.where(~((kind == 1) & (F.col("draw") == 0))).withColumns({"x": F.col("x") + moved, "w": F.col("w") + F.when((kind == 2) & ~later, 1).otherwise(0)})
    return X.geometry_outcome(before, after, ["l_orderkey"], ["draw"], ["w"], ["x", "y"])


@query("""
WITH v AS (SELECT l_orderkey AS k, list(l_quantity::INTEGER % 8 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, (k % 8)::INTEGER AS entries, len(list_filter(i, lambda x: x >= k % 8))::INTEGER AS beyond, len(list_filter(i, lambda x: x >= k % 8)) > 0 AS undetermined FROM v""")
def palette_completions(spark, sf):
    """Indexed images whose palettes were cut short: whether what is left still says how they look."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("r"))
    images = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: (r["l_quantity"].cast("int") % 8)).alias("i"))
    palette = F.unhex(F.repeat(F.lit("102030"), (F.col("l_orderkey") % 8).cast("int")))
    return images.select("l_orderkey", X.completions(palette, F.col("i")).alias("c")).select("l_orderkey", "c.entries", "c.beyond", "c.undetermined")


# ---------------------------------------------------------------- proofs


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 6 THEN p_partkey WHEN p_partkey % 11 = 10 THEN -1 ELSE p_partkey // 2 END AS next FROM part),
w(node, here, steps, ended) AS (SELECT node, coalesce(next, node), CASE WHEN next IS NULL THEN 0 ELSE 1 END, next IS NULL FROM e UNION ALL SELECT w.node, coalesce(e.next, e.node), w.steps + CASE WHEN e.next IS NULL THEN 0 ELSE 1 END, e.next IS NULL FROM w JOIN e ON e.node = w.here WHERE NOT w.ended AND w.steps <= 16),
r AS (SELECT node, here AS target, steps FROM w WHERE ended AND steps <= 16)
SELECT e.node, r.target, r.steps::INTEGER AS steps, CASE WHEN r.node IS NULL THEN 'REFUSED' ELSE 'RESOLVED' END AS status FROM e LEFT JOIN r USING (node)""")
def resolved_references(spark, sf):
    """Chains of references to their ends; cycles and ends that are no node are refused."""
    key = F.col("p_partkey")
    following = F.when(key % 5 == 0, None).when(key % 7 == 6, key).when(key % 11 == 10, -1).otherwise(F.floor(key / 2))
    return P.resolved(table(spark, sf, "part").select(key.alias("node"), following.cast("long").alias("next")))


_NESTED = "SELECT n_nationkey AS owner, n_regionkey AS r, n_name AS name FROM nation"


@query("""
SELECT n_nationkey AS owner, array_to_string(list_sort(list_filter([CASE WHEN n_nationkey % 5 = 2 THEN '$.box[1].id' END, CASE WHEN n_regionkey = 2 THEN '$.region' END, CASE WHEN n_nationkey = 2 THEN '$.box[0].id' END], lambda x: x IS NOT NULL)), ',') AS paths
FROM nation WHERE n_nationkey % 5 = 2 OR n_regionkey = 2 OR n_nationkey = 2""")
def reference_owners(spark, sf):
    """All paths in nested documents that hold the value 2, by owner."""
    nation = table(spark, sf, "nation")
    item = lambda v: F.struct(v.cast("int").alias("id"), F.lit("2").alias("text"))
    document = F.to_json(F.struct(F.col("n_regionkey").cast("int").alias("region"), F.array(item(F.col("n_nationkey")), item(F.col("n_nationkey") % 5)).alias("box")))
    leaves = nation.select(F.col("n_nationkey").alias("owner"), F.explode(nested.leaves(document)).alias("l")).select("owner", "l.*")
    return P.paths_to(leaves, "owner", F.lit("2")).withColumn("paths", F.array_join("paths", ","))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 OR NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 1) OR o_orderkey % 13 = 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 1) THEN 'predecessor' END, CASE WHEN o_custkey % 9 = 0 THEN 'candidate' END, CASE WHEN o_orderkey % 13 = 0 THEN 'review' END) AS missing FROM orders o""")
def lineage_of_versions(spark, sf):
    """Receipts whose predecessor, candidate and review must all exist."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") - 1).alias("before"), "o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("review"))
    known = table(spark, sf, "customer").where("c_custkey % 9 != 0").select("c_custkey")
    return P.lineage(orders, "o_orderkey", {"predecessor": ("before", orders.select("o_orderkey")), "candidate": ("o_custkey", known), "review": ("review", orders.select("o_orderstatus" if "o_orderstatus" in orders.columns else "review").where("review IS NOT NULL"))})


@query("""
WITH c AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0)::BIGINT AS candidates, CASE WHEN n = 1 THEN s END AS l_suppkey FROM orders LEFT JOIN c ON k = o_orderkey""")
def only_candidates(spark, sf):
    """A lookup that counts only where there is exactly one answer."""
    found = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return P.only_candidate(table(spark, sf, "orders").select("o_orderkey"), found, ["o_orderkey"], "l_suppkey")


@query("""
SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id >= 100 AND event_type = 'click' GROUP BY 1""")
def latest_since(spark, sf):
    """Each user's last click that is not before a given event."""
    return P.latest_since(table(spark, sf, "events").where("event_type = 'click'"), ["user_id"], "event_id", F.lit(100), ["event_id", "value"])


@query("""
WITH a AS (SELECT conv_id, turn, length(text) % 7 AS d, length(text) % 5 AS p FROM conversations), b AS (SELECT conv_id - 1 AS conv_id, turn, length(text) % 7 AS d, length(text) % 5 AS p FROM conversations WHERE conv_id > 0)
SELECT conv_id, count(*)::BIGINT AS compared, count(*) FILTER (a.d IS NULL OR b.d IS NULL)::BIGINT AS unpaired, count(*) FILTER (a.d = b.d)::BIGINT AS same_d, count(*) FILTER (a.p = b.p)::BIGINT AS same_p FROM a FULL JOIN b USING (conv_id, turn) GROUP BY 1""")
def alignment_scores(spark, sf):
    """How well each conversation's turns line up with those of the next one."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 7).alias("d"), (F.length("text") % 5).alias("p"))
    return P.alignment(turns, turns.where("conv_id > 0").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn", ["d", "p"])


@query("""
WITH p AS (SELECT p_partkey, ['a/../b', 'a/../../b', '/a', './a/b', '..', 'a//b/../..', ''][p_partkey % 7 + 1] || '/x' AS path FROM part),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS s FROM p),
d AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END))) AS d FROM s)
SELECT p_partkey, path, NOT starts_with(path, '/') AND coalesce(list_min(d), 0) >= 0 AS contained FROM d""")
def contained_paths(spark, sf):
    """Relative paths that must stay below their root."""
    kinds = F.array(*map(F.lit, ["a/../b", "a/../../b", "/a", "./a/b", "..", "a//b/../..", ""]))
    path = F.concat(F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("/x"))
    return table(spark, sf, "part").select("p_partkey", path.alias("path")).withColumn("contained", P.contained(F.col("path")))


@query("""
SELECT s_suppkey, s_name = 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') AS plain, s_name = 'Supplier_' || s_suppkey AS joined FROM supplier""")
def template_names(spark, sf):
    """Names that are their template filled in."""
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select("s_suppkey", P.matches_template(F.col("s_name"), "Supplier#{n}", {"n": F.lpad(key, 9, "0")}).alias("plain"), P.matches_template(F.col("s_name"), "Supplier_{n}", {"n": key}).alias("joined"))


@query("""
WITH r AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS q, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT k, n, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN list_concat(q, q[1:1]) WHEN 2 THEN list_transform(q, lambda x: x + 1) ELSE q END AS q FROM r)
SELECT k AS l_orderkey, CASE WHEN len(q) = 0 THEN array_to_string(range(1, n + 1), ',') WHEN len(list_distinct(q)) = len(q) AND list_max(q) <= n AND list_min(q) >= 1 THEN array_to_string(q, ',') END AS route FROM a""")
def page_routes(spark, sf):
    """Pages to visit: those asked for if they are distinct and exist, all if none are asked for."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("q"), F.count(F.lit(1)).alias("n"))
    kind = F.col("l_orderkey") % 4
    asked = F.when(kind == 0, F.array().cast("array<bigint>")).when(kind == 1, F.concat("q", F.slice("q", 1, 1))).when(kind == 2, F.transform("q", lambda x: x + 1)).otherwise(F.col("q"))
    return rows.select("l_orderkey", F.array_join(P.route(asked, F.col("n")), ",").alias("route"))


@query("""
SELECT n_nationkey, '{"name":"' || n_name || '","pins":[{"size":' || n_nationkey || '},{"size":' || n_regionkey || '}]}' AS identity, '[{"ordinal":1,"size":' || n_nationkey || '},{"ordinal":2,"size":' || n_regionkey || '}]' AS summary FROM nation""")
def identities_without_places(spark, sf):
    """Nested manifests without where things are kept, and a summary by ordinals."""
    nation = table(spark, sf, "nation")
    pin = lambda c: F.struct(F.concat(F.lit("/store/"), "n_name").alias("location"), F.col(c).cast("int").alias("size"))
    manifest = nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.lit("/store").alias("location"), F.array(pin("n_nationkey"), pin("n_regionkey")).alias("pins")).alias("m"))
    return manifest.select("n_nationkey", F.to_json(P.without(F.col("m"), manifest.schema["m"].dataType, {"location"})).alias("identity"), F.to_json(P.summary_of(F.col("m.pins"), ["size"])).alias("summary"))


@query("""
SELECT p_partkey, p_partkey % 3 <> 1 AS framed, CASE WHEN p_partkey % 4 <> 2 THEN upper(md5(p_name))[1:4] || upper(md5(p_name))[5:8] END AS cut FROM part""")
def framed_rasters(spark, sf):
    """Rasters whose four edges must have colours of their own, and what is cut out where the marks are right."""
    key, h = F.col("p_partkey"), F.upper(F.md5(F.col("p_name").cast("binary")))
    side = F.when(key % 3 == 1, "09").otherwise("04")
    row = lambda a: F.concat(F.lit("03"), F.substring(h, a, 4), side)
    data = F.unhex(F.concat(F.when(key % 4 == 2, "01010102").otherwise("01010101"), row(1), row(5), F.lit("02020202")))
    plain = F.unhex(F.concat(F.lit("01010101"), row(1), row(5), F.lit("02020202")))
    rows = table(spark, sf, "part").select("p_partkey", data.alias("d"), plain.alias("p"))
    cut = rasters.marked_crop(F.col("d"), F.lit(4), [(0, 1), (3, 1), (12, 2)], F.lit(1), F.lit(1), F.lit(2), F.lit(2))
    return rows.select("p_partkey", rasters.edges_are(F.col("p"), F.lit(4), {"top": 1, "bottom": 2, "left": 3, "right": 4}).alias("framed"), F.hex(cut).alias("cut"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 3 AS b, CASE p_partkey % 4 WHEN 0 THEN 3 * (1 << (p_size % 3)) WHEN 1 THEN 3 * (1 << (p_size % 3)) - 3 WHEN 2 THEN 3 * (1 << (p_size % 3)) + 3 ELSE 3 * (1 << (p_size % 3)) + 1 END AS n FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SHORT' WHEN 2 THEN 'EXTRA' ELSE 'UNALIGNED' END AS fit FROM p""")
def palette_fits(spark, sf):
    """Palettes against what their indices can reach."""
    bits = F.col("p_size") % 3
    wanted = 3 * F.call_function("shiftleft", F.lit(1), bits.cast("int"))
    size = wanted + F.element_at(F.array(*map(F.lit, [0, -3, 3, 1])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", rasters.palette_fit(F.unhex(F.repeat(F.lit("AB"), size)), bits).alias("fit"))


@query("""
WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, CASE k % 3 WHEN 0 THEN len(p) >= 2 WHEN 1 THEN len(p) >= 2 AND p[1] = p[2] ELSE false END AS same FROM l""")
def mapped_orders(spark, sf):
    """The first and second payload of a source must be what the output has, in this order; some outputs have them turned, some have one more."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", place.alias("place"), "l_partkey")
    source = lines.withColumn("side", F.lit(0))
    kind = F.col("l_orderkey") % 3
    output = lines.where((F.col("place") <= 2) | ((kind == 2) & (F.col("place") == 3))).withColumns({"place": F.when(kind == 1, -F.col("place")).otherwise(F.col("place")), "side": F.lit(1)})
    short = lines.where((F.col("place") == 1) & (kind == 2)).withColumns({"place": F.lit(9), "side": F.lit(1)})
    return P.same_order(source.unionByName(output).unionByName(short), ["l_orderkey"], "side", ["place"], "l_partkey", [1, 2])

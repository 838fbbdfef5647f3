"""Queries of ranged files, walks, chains, ranks, digests, nested hashes, versions, snapshots and piecewise functions, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import piecewise as PW
from quarry.functions import variants as V
from quarry.functions.stored import shared_folder
from quarry.operators import proofs as P
from quarry.operators import ranks as K
from quarry.operators import walks as W
from quarry.plans.formats import bound_batches
from quarry.sources import binary_sink, generators, ranges, versions
from quarry.sources import containers as C
from quarry.streaming import snapshots as SN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- ranged files


@query("""
WITH d AS (SELECT doc_id // 20 AS batch, doc_id, text FROM documents),
t AS (SELECT batch, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM d GROUP BY batch),
l AS (SELECT batch, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM t)
SELECT batch, page::INTEGER AS page_number, octet_length(encode(line))::BIGINT AS text_length, CASE WHEN line <> '' THEN sha256(line) END AS text_sha256 FROM l""")
def container_pages_by_range(spark, sf):
    """Containers of twenty documents each as files, whose pages are read by offsets."""
    bound_batches(spark)
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("batch"), F.struct("doc_id", "text").alias("d"))
    texts = docs.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["text"]), "\n").alias("text"))
    folder = f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}"
    binary_sink.write_files(texts.select(F.concat(F.col("batch").cast("string"), F.lit(".c8")).alias("name"), generators.container_of_lines("text").alias("content")), folder)
    pages = C.good_pages(C.read_pages_by_range(spark, folder, range_bytes=64 << 10))
    return pages.select(F.regexp_extract("source", r"(\d+)\.c8$", 1).cast("long").alias("batch"), "page_number", "text_length", "text_sha256")


@query("""
WITH d AS (SELECT doc_id, encode(text) AS b FROM documents)
SELECT doc_id, k::BIGINT AS block, least(1000, octet_length(b) - 1000 * k)::BIGINT AS length FROM (SELECT doc_id, b, unnest(range(0, (octet_length(b) + 999) // 1000)) AS k FROM d)""")
def ranged_blocks(spark, sf):
    """Texts as files without any structure, read in blocks of 1,000 bytes."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    binary_sink.write_files(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".bin")).alias("name"), F.encode("text", "UTF-8").alias("content")), folder)
    blocks = ranges.read_ranges(spark, folder, block=1000)
    return blocks.select(F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("long").alias("doc_id"), (F.col("start") / 1000).cast("long").alias("block"), F.octet_length("content").cast("long").alias("length"))


@query(f"""
WITH t0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY encode(source || '/' || doc_id || '.txt')) - 1 AS o, sha256(source || '/' || doc_id || '.txt ' || octet_length(encode(text)) || ' ' || sha256(text) || chr(10)) AS d, 1 AS n FROM documents),
{", ".join(f"t{k} AS (SELECT g, o // 256 AS o, sha256(string_agg(d, '' ORDER BY o)) AS d, sum(n) AS n FROM t{k - 1} GROUP BY g, o // 256)" for k in range(1, 5))}
SELECT g AS folder, n::BIGINT AS n, d AS sha256 FROM t4""")
def folder_digests(spark, sf):
    """Texts as files in folders by source; a folder's digest covers its files' paths, sizes and hashes in the order of paths."""
    root = f"{shared_folder(spark)}/folders-{uuid.uuid4().hex}"
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    binary_sink.write_files(table(spark, sf, "documents").select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root)
    files = ranges.file_hashes(spark, root).withColumn("folder", F.substring_index("file", "/", 1))
    return K.ordered_digest(files, ["folder"], ["file"], F.concat_ws(" ", "file", "size", "sha256"), fan=256)


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 6 AS kind FROM lineitem),
c AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, p_size + 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 = 1),
o AS (SELECT k, count(DISTINCT v) AS n, min(v) AS v FROM c GROUP BY k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN kind IN (1, 2) THEN l_suppkey WHEN kind IN (0, 3) AND n = 1 THEN v END::BIGINT AS size,
  CASE WHEN kind IN (1, 2) THEN 'PASS' WHEN kind NOT IN (0, 3) THEN 'UNSUPPORTED' WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'PASS' END AS status FROM l LEFT JOIN o ON l_partkey = k""")
def dispatched_lookups(spark, sf):
    """Records of two kinds have their own value, of two others that of exactly one candidate."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    candidates = part.where("p_partkey % 4 > 0").unionByName(part.where("p_partkey % 3 = 0").withColumn("size", F.col("size") + 1)).unionByName(part.where("p_partkey % 5 = 1"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 6).alias("kind"))
    return P.dispatched(lines, "kind", F.col("l_suppkey"), [1, 2], [0, 3], candidates.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], "size").drop("kind")


# ---------------------------------------------------------------- walks and chains

_EDGES = """
c AS (SELECT c_nationkey AS graph, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
e AS (SELECT graph, 'c' || k AS source, 'o' || o_orderkey AS target FROM c JOIN orders ON o_custkey = k
      UNION ALL SELECT graph, 'o' || o_orderkey, 'c' || next FROM c JOIN orders ON o_custkey = k WHERE next IS NOT NULL AND n % 4 > 0
      UNION ALL SELECT graph, 'o' || o_orderkey, 'hub' FROM c JOIN orders ON o_custkey = k WHERE o_orderkey % 3 = 0
      UNION ALL SELECT graph, 'hub', 'c' || k FROM c WHERE n % 7 = 1),
r0 AS (SELECT graph, 'c' || min(k) AS node FROM c GROUP BY graph)"""
_REACHED = f"""{_EDGES},
r(graph, node, depth) AS (SELECT graph, node, 0 FROM r0 UNION SELECT r.graph, e.target, r.depth + 1 FROM r JOIN e ON r.graph = e.graph AND r.node = e.source WHERE r.depth < 13),
m AS (SELECT graph, node, min(depth) AS depth FROM r GROUP BY graph, node),
v AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY depth, encode(node)) AS n FROM m),
w AS (SELECT * FROM v WHERE depth <= 12 AND n <= 400)"""


def object_graph(spark, sf):
    """Graphs of nations: customers lead to their orders, orders to the next customer and some to a hub, and the hub back to customers: cycles, diamonds and a node of many edges."""
    by_key = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("graph"), F.col("c_custkey").alias("k"), F.lead("c_custkey").over(by_key).alias("next"), F.row_number().over(by_key).alias("n"))
    owned = customers.join(table(spark, sf, "orders"), F.col("k") == F.col("o_custkey"))
    c, o = (lambda x: F.concat(F.lit("c"), x.cast("string"))), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    edge = lambda df, a, b: df.select("graph", a.alias("source"), b.alias("target"))
    edges = edge(owned, c(F.col("k")), o).unionByName(edge(owned.where("next IS NOT NULL AND n % 4 > 0"), o, c(F.col("next"))))
    edges = edges.unionByName(edge(owned.where("o_orderkey % 3 = 0"), o, F.lit("hub"))).unionByName(edge(customers.where("n % 7 = 1"), F.lit("hub"), c(F.col("k"))))
    return edges, customers.groupBy("graph").agg(F.min("k").alias("k")).select("graph", c(F.col("k")).alias("node"))


@query(f"""
WITH RECURSIVE {_REACHED}
SELECT w.graph, w.node, w.depth::INTEGER AS depth, (SELECT min(e.source) FROM e JOIN w x ON e.graph = x.graph AND e.source = x.node WHERE e.graph = w.graph AND e.target = w.node AND x.depth = w.depth - 1) AS parent FROM w""")
def object_walk(spark, sf):
    """What a walk of twelve levels and 400 objects reaches in each nation's graph, with the parent of the first visit."""
    return W.walk(*object_graph(spark, sf), most_depth=12, most_visits=400)[0]


@query(f"""
WITH RECURSIVE {_REACHED},
a AS (SELECT graph, count(*) AS visits, max(depth) AS depth FROM w GROUP BY graph),
l AS (SELECT graph, depth, count(*) AS n, count(*) FILTER (n <= 400) AS kept FROM v GROUP BY graph, depth),
x AS (SELECT graph, min(depth) AS depth FROM l WHERE kept < n GROUP BY graph),
s AS (SELECT graph, min_by(n - (CASE WHEN depth <= 12 THEN kept ELSE 0 END), depth) AS unvisited, min_by(CASE WHEN depth > 12 THEN 'DEPTH_LIMIT' ELSE 'VISIT_LIMIT' END, depth) AS status FROM l WHERE depth > 12 OR kept < n GROUP BY graph)
SELECT graph, coalesce(status, 'COMPLETE') AS status, visits, a.depth::INTEGER AS depth, coalesce(unvisited, 0)::BIGINT AS unvisited FROM a LEFT JOIN s USING (graph)""")
def object_walk_ends(spark, sf):
    """Where each walk ended, and what it left unvisited."""
    return W.walk(*object_graph(spark, sf), most_depth=12, most_visits=400)[1]


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_totalprice::VARCHAR AS price, o_orderkey % 97 = 5 AS hurt, o_orderkey % 89 = 3 AS unreviewed FROM orders),
f AS (SELECT *, CASE WHEN unreviewed THEN 'review missing' WHEN hurt THEN 'digest' END AS fault FROM o),
c AS (SELECT o_custkey, max(o_orderkey) AS step, min(o_orderkey) AS first, count(*) AS length, count(fault) AS faults, min(o_orderkey) FILTER (fault IS NOT NULL) AS broken FROM f GROUP BY o_custkey)
SELECT step, first, length, faults, broken, fault, CASE WHEN faults > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c LEFT JOIN (SELECT o_orderkey, fault FROM f) g ON g.o_orderkey = c.broken""")
def history_chains(spark, sf):
    """The orders of a customer as a history of receipts: each covers the digest of the one before; some are altered afterwards, and some have no review."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(order).alias("before"), F.col("o_totalprice").cast("string").alias("price"))
    each = F.struct("o_orderkey", "before", "price")
    histories = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(each)).alias("h"))
    link = lambda a, x: F.sha2(F.concat_ws("|", a, x["price"]).cast("binary"), 256)
    digests = F.aggregate("h", F.expr("cast(array('') AS array<string>)"), lambda a, x: F.concat(a, F.array(link(F.element_at(a, -1), x))))
    receipts = histories.select(F.explode(F.arrays_zip(F.col("h"), F.slice(digests, F.lit(2), F.size("h")).alias("digest"))).alias("r")).select(F.col("r.h.o_orderkey").alias("step"), F.col("r.h.before").alias("before"), F.col("r.h.price").alias("price"), F.col("r.digest").alias("digest"))
    altered = receipts.withColumn("price", F.when(F.col("step") % 97 == 5, F.concat("price", F.lit("0"))).otherwise(F.col("price"))).withColumn("review", F.col("step"))
    reviews = receipts.where("step % 89 <> 3").select("step")
    covers = F.col("digest") == F.sha2(F.concat_ws("|", F.coalesce("before_digest", F.lit("")), "price").cast("binary"), 256)
    return W.chains(W.step_checks(altered, {"review": ("review", reviews)}, covers))


# ---------------------------------------------------------------- ranks and digests


@query("""
SELECT 'all' AS g, quantile_cont(l_extendedprice, [0.5, 0.9, 0.95, 0.99, 1.0]) AS quantiles FROM lineitem UNION ALL
SELECT l_returnflag, quantile_cont(l_extendedprice, [0.5, 0.9, 0.95, 0.99, 1.0]) FROM lineitem GROUP BY 1""")
def quantiles_by_rank(spark, sf):
    """Exact quantiles of all prices as one group, and by flag."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    shares = [0.5, 0.9, 0.95, 0.99, 1.0]
    return K.quantiles(lines.select(F.lit("all").alias("g"), "v").unionByName(lines.select(F.col("l_returnflag").alias("g"), "v")), ["g"], "v", shares)


def _tree(level: int) -> str:
    return f"t{level} AS (SELECT g, o // 256 AS o, sha256(string_agg(d, '' ORDER BY o)) AS d, sum(n) AS n FROM t{level - 1} GROUP BY g, o // 256)"


@query(f"""
WITH l AS (SELECT 'all' AS g, * FROM lineitem UNION ALL SELECT l_returnflag, * FROM lineitem),
t0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY l_orderkey, l_linenumber, h) - 1 AS o, h AS d, 1 AS n FROM (SELECT *, sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || chr(10)) AS h FROM l)),
{_tree(1)}, {_tree(2)}, {_tree(3)}, {_tree(4)}
SELECT g, n::BIGINT AS n, d AS sha256 FROM t4""")
def ordered_digests(spark, sf):
    """Digests of all lines in order as one group, and by flag, without a group in one row."""
    lines = table(spark, sf, "lineitem")
    rows = lines.withColumn("g", F.lit("all")).unionByName(lines.withColumn("g", F.col("l_returnflag")))
    return K.ordered_digest(rows, ["g"], ["l_orderkey", "l_linenumber"], F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), fan=256)


# ---------------------------------------------------------------- nested values


def nested_orders(spark, sf):
    """Orders with their lines as nested documents."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat(F.lit("files/"), "l_suppkey").alias("path")))).alias("lines"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    item = lambda x: F.concat(F.lit('{"path":"'), x["path"], F.lit('","line":'), x["l_linenumber"].cast("string"), F.lit(',"part":'), x["l_partkey"].cast("string"), F.lit("}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("lines", F.expr("cast(array() AS array<struct<l_linenumber: int, l_partkey: bigint, path: string>>)")), item), ","), F.lit("]"))
    status = F.concat(F.lit('"status":"'), "o_orderstatus", F.lit('"'))
    flag = F.concat(F.lit('"odd":'), F.when(F.col("o_orderkey") % 2 == 1, "true").otherwise("false"))
    swapped = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("{"), flag, F.lit(","), status)).otherwise(F.concat(F.lit("{"), status, F.lit(","), flag))
    return orders.select("o_orderkey", F.concat(swapped, F.lit(',"lines":'), listed, F.lit(',"none":null}')).alias("doc"))


_LEAF = "sha256('{tag}:' || {value})"
_NESTED = f"""
i AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, sha256('{{4:line' || {_LEAF.format(tag="int", value="l_linenumber")} || '{{4:part' || {_LEAF.format(tag="int", value="l_partkey")} || '{{4:path' || {_LEAF.format(tag="str", value="'files/' || l_suppkey")}) AS h FROM lineitem),
a AS (SELECT l_orderkey, sha256(string_agg('[' || h, '' ORDER BY n, l_partkey, 'files/' || l_suppkey)) AS h FROM i GROUP BY l_orderkey)"""


@query(f"""
WITH {_NESTED}
SELECT o_orderkey, sha256('{{5:lines' || coalesce(a.h, sha256('array:[]')) || '{{4:none' || sha256('null:null') || '{{3:odd' || sha256('bool:' || (o_orderkey % 2 = 1)) || '{{6:status' || sha256('str:' || o_orderstatus)) AS sha256, NULL::VARCHAR AS fault
FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""")
def nested_hashes(spark, sf):
    """Canonical hashes of orders with their lines; a third of them has its keys in another order."""
    return V.value_hashes(nested_orders(spark, sf), ["o_orderkey"], "doc")


@query("""
SELECT l_orderkey AS o_orderkey, '$.lines[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, 'files/' || l_suppkey) - 1) || ']' AS path, l_linenumber::VARCHAR AS line, 'files/' || l_suppkey AS file FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def nested_references(spark, sf):
    """Every file that an order names, wherever it stands in the document."""
    return V.value_references(nested_orders(spark, sf), ["o_orderkey"], "doc", ["line", "path"]).toDF("o_orderkey", "path", "line", "file")


@query("""
WITH i AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, 'files/' || l_suppkey) - 1 AS i, l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT o AS o_orderkey, '$.lines[' || i || '].part' AS path, sha256('int:' || p) AS before, sha256('int:1' || p) AS after FROM i WHERE o % 5 = 0
UNION ALL SELECT o_orderkey, '$.none', sha256('null:null'), NULL FROM orders WHERE o_orderkey % 7 = 0""")
def nested_differences(spark, sf):
    """Documents against versions of them with other parts and without a member: paths and hashes of both."""
    before = nested_orders(spark, sf)
    other = F.when(F.col("o_orderkey") % 5 == 0, F.regexp_replace("doc", r'"part":(?<p>\d+)', '"part":1${p}')).otherwise(F.col("doc"))
    other = F.when(F.col("o_orderkey") % 7 == 0, F.replace(other, F.lit(',"none":null'), F.lit(""))).otherwise(other)
    after = before.select("o_orderkey", other.alias("doc"))
    return V.value_differences(before, after, ["o_orderkey"], "doc")


# ---------------------------------------------------------------- versions, snapshots, piecewise functions


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY ALL""")
def published_version(spark, sf):
    """A table published within a budget, verified file by file and read back."""
    with versions.Version(spark, shared_folder(spark), f"published-{uuid.uuid4().hex}", versions.Budget(output_rows=1 << 40)) as version:
        version.put("lines", table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey"))
    changed = versions.verified(spark, version.path).where("status <> 'OK'")
    lines = versions.read_version(spark, version.path, "lines")
    sound = lines.join(changed.select(F.lit(1).alias("_changed")).limit(1), F.lit(True), "left_anti")
    return sound.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


_PARTS = """
p AS (SELECT 's' || (event_id // 4) % 50 AS session, event_id // 4 AS tick, event_id % 4 AS part, 3 + (event_id // 4) % 3 AS parts, epoch_ms(date_trunc('second', ts)) AS ms FROM events),
k AS (SELECT session, tick, part, min(ms) AS ms, max(parts) AS parts FROM p GROUP BY ALL),
f AS (SELECT session, tick, min(ms) AS first, max(parts) AS parts, list(ms) AS times FROM k GROUP BY ALL),
d AS (SELECT session, tick, parts, list_filter(times, lambda t: t <= first + 40000000) AS c FROM f)
SELECT session, max_by(tick, (list_max(c), tick))::BIGINT AS tick, max(list_max(c))::BIGINT AS "at" FROM d WHERE len(c) = parts GROUP BY session"""


def snapshot_parts(events):
    """Events as parts of snapshots: four successive ones make a tick, which asks for three to five."""
    tick = F.floor(F.col("event_id") / 4)
    return events.select(F.concat(F.lit("s"), (tick % 50).cast("string")).alias("session"), tick.alias("tick"), (F.col("event_id") % 4).alias("part"), (3 + tick % 3).cast("int").alias("parts"), F.date_trunc("second", F.col("ts")).cast("timestamp").alias("at"))


@query(f"WITH {_PARTS}")
def complete_snapshots(spark, sf):
    """Each session's latest complete snapshot, of all events at once."""
    return SN.latest_complete(snapshot_parts(table(spark, sf, "events")), 40_000_000)


@query(f"WITH {_PARTS}")
def streamed_snapshots(spark, sf):
    """The same by a stream over the events, run to its end; a last event far ahead moves the watermark past all others."""
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    parts = snapshot_parts(table(spark, sf, "events"))
    parts.write.parquet(f"{folder}/in/0")
    ahead = parts.agg((F.max("at") + F.expr("INTERVAL 3650 DAYS")).alias("at"))
    for i in (1, 2):
        ahead.select(F.lit("end").alias("session"), F.lit(-1).cast("long").alias("tick"), F.lit(0).cast("long").alias("part"), F.lit(9).alias("parts"), (F.col("at") + F.expr(f"INTERVAL {i} DAYS")).alias("at")).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    run = SN.snapshots(stream, 40_000_000, "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    found = spark.read.schema(SN.DECIDED).parquet(f"{folder}/out").where(F.col("status") != SN.INCOMPLETE)
    return found.groupBy("session").agg(F.max(F.struct("at", "tick")).alias("s")).select("session", "s.tick", "s.at")


_PIECES = [PW.Piece(1, 10, Fraction(1, 3), Fraction(1, 2)), PW.Piece(10, 25, Fraction(-2, 7), Fraction(40)), PW.Piece(25, 26, Fraction(0), Fraction(5, 6)), PW.Piece(30, 51, Fraction(3, 4), Fraction(-1, 6))]


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS x FROM lineitem),
v AS (SELECT *, CASE WHEN x BETWEEN 1 AND 9 THEN 2 * x + 3 WHEN x BETWEEN 10 AND 24 THEN 280 - 2 * x WHEN x = 25 THEN 5 WHEN x BETWEEN 30 AND 50 THEN 9 * x - 2 END AS n,
  CASE WHEN x BETWEEN 1 AND 9 THEN 6 WHEN x BETWEEN 10 AND 24 THEN 7 WHEN x = 25 THEN 6 WHEN x BETWEEN 30 AND 50 THEN 12 END AS d FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (n // gcd(n, d))::BIGINT AS numerator, (d // gcd(n, d))::BIGINT AS denominator FROM v""")
def piecewise_values(spark, sf):
    """A function of the quantity in four pieces with a gap, as exact fractions."""
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", PW.value(F.col("l_quantity").cast("long"), _PIECES).alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.*")


@query("""
WITH p AS (SELECT o_orderkey * 4 AS start, o_orderkey * 4 + o_custkey % 4 AS stop, o_custkey AS owner FROM orders WHERE o_custkey % 4 > 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, owner FROM (SELECT *, l_orderkey * 4 + l_linenumber % 4 AS x FROM lineitem) l LEFT JOIN p ON x >= start AND x < stop""")
def pieces_by_bins(spark, sf):
    """Lines in the piece of a table of many that their place is in."""
    pieces = table(spark, sf, "orders").where("o_custkey % 4 > 0").select((F.col("o_orderkey") * 4).alias("start"), (F.col("o_orderkey") * 4 + F.col("o_custkey") % 4).alias("stop"), F.col("o_custkey").alias("owner"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).alias("x"))
    return PW.piece_of(lines, "x", pieces).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "owner")

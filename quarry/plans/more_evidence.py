"""Further queries of the engine's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import audit as AU
from quarry.operators import joins as J
from quarry.operators import sequences as S
from quarry.operators import trees as TR

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
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM documents UNION ALL SELECT doc_id + 1000000000, 'UNDECLARED' FROM documents WHERE doc_id % 50 = 0""")
def reaudit_inventory(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    later = docs.where("doc_id % 11 != 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")))
    extra = docs.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return AU.reaudit(docs, later.unionByName(extra), ["doc_id"], ["sha256"])


@query("""
SELECT event_type, count(*) FILTER (value <= 20)::BIGINT AS pass, count(*) FILTER (value > 20 AND value <= 60)::BIGINT AS fail, count(*) FILTER (value > 60)::BIGINT AS not_run, count(*)::BIGINT AS attempted FROM events GROUP BY 1""")
def outcomes_by_kind(spark, sf):
    status = F.when(F.col("value") <= 20, "PASS").when(F.col("value") <= 60, "FAIL").otherwise("NOT_RUN")
    return AU.by_kind(table(spark, sf, "events").withColumn("status", status), "event_type", "status", ["PASS", "FAIL", "NOT_RUN"])


@query("""
SELECT user_id, count(*)::BIGINT AS rows, count(*) FILTER (value < 90)::BIGINT AS good, bool_and(value < 90) AS all_good FROM events GROUP BY 1""")
def folded_groups(spark, sf):
    return AU.folded(table(spark, sf, "events"), ["user_id"], F.col("value") < 90)


@query("""
WITH a AS (SELECT doc_id // 2 AS page, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS page, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 <> 3)
SELECT page, CASE WHEN a.h IS NULL OR b.h IS NULL THEN 'NOT_CONFIRMED' WHEN a.h = b.h THEN 'STABLE' ELSE 'UNSTABLE' END AS status FROM a FULL JOIN b USING (page)""")
def observation_stability(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("page"), F.sha2("text", 256).alias("h"))
    return AU.stability(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 AND doc_id % 5 != 3"), ["page"], "h")


@query("""
SELECT doc_id, coalesce(n_name, 'NATION_0') AS role FROM documents LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0) ON doc_id % 25 = n_nationkey""")
def role_with_default(spark, sf):
    roles = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("role"))
    return AU.role_of(table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 25).cast("string").alias("key")), roles, "key", "0").select("doc_id", "role")


@query("""
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS node, conv_id FROM conversations), l(head, node, place) AS (SELECT node, node, 0::BIGINT FROM t WHERE node % 1000 < 2 UNION ALL SELECT l.head, t.node, place + 1 FROM l JOIN t ON t.node = l.node + 2 AND t.node // 1000 = l.node // 1000)
SELECT * FROM l""")
def linked_lists(spark, sf):
    """Two lists for each conversation: that of its even turns and that of its odd ones."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "conv_id")
    following = turns.select((F.col("node") - 2).alias("node"), F.col("node").alias("next"), "conv_id")
    return AU.chains(turns.join(following, ["node", "conv_id"], "left").select("node", "next"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_suppkey) OVER w AS before, l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT count(*) FILTER (before IS NOT NULL AND before <> 0)::BIGINT AS pairs, count(*) FILTER (before < l_suppkey)::BIGINT AS rising FROM l""")
def lag_pair_check(spark, sf):
    rows = S.adjacent(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_suppkey"])
    return rows.agg(F.count_if(F.col("before.l_suppkey") != 0).alias("pairs"), F.count_if(F.col("before.l_suppkey") < F.col("l_suppkey")).alias("rising"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS b FROM orders), t AS (SELECT *, lag(b + 30) OVER (PARTITION BY o_custkey ORDER BY b, b + 30) AS e FROM s)
SELECT o_custkey, count(*)::BIGINT AS n FROM t WHERE e IS NOT NULL AND e + 1 <> b GROUP BY 1""")
def contiguous_spans(spark, sf):
    b = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, sf, "orders").select("o_custkey", b.alias("b"), (b + 30).alias("e"))
    return S.tiles(spans, ["o_custkey"], "b", "e").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderpriority, count(DISTINCT o_orderstatus) = 1 AS uniform FROM orders GROUP BY 1""")
def uniform_markers(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg((F.count_distinct("o_orderstatus") == 1).alias("uniform"))


@query("""
WITH u AS (SELECT ts, user_id, event_id, 0 AS side FROM events WHERE event_type = 'click' UNION ALL SELECT ts, user_id, event_id, 1 FROM events WHERE event_type = 'view')
SELECT event_id, side, row_number() OVER (PARTITION BY user_id ORDER BY ts, side, event_id) AS place FROM u""")
def merged_logs(spark, sf):
    events = table(spark, sf, "events").select("ts", "user_id", "event_id", "event_type")
    both = events.where("event_type = 'click'").withColumn("side", F.lit(0)).unionByName(events.where("event_type = 'view'").withColumn("side", F.lit(1)))
    return both.select("event_id", "side", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "side", "event_id")).cast("long").alias("place"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (ts <= TIMESTAMP '2024-01-15 00:00:00') AS latest FROM events GROUP BY 1 HAVING count(*) FILTER (ts <= TIMESTAMP '2024-01-15 00:00:00') > 0""")
def latest_complete_snapshot(spark, sf):
    before = table(spark, sf, "events").where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return before.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""
WITH k AS (SELECT 'orders' AS origin, o_custkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT 'again', o_custkey, o_orderstatus FROM orders UNION ALL SELECT 'customer', c_custkey, 'O' FROM customer)
SELECT k, count(DISTINCT v)::BIGINT AS n_values FROM k GROUP BY k HAVING count(DISTINCT v) > 1""")
def oracle_union_conflicts(spark, sf):
    """Receipts of three shapes brought to one key; equal duplicates collapse, conflicts are rows."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("O").alias("v"))
    return J.agree(orders.unionByName(orders).unionByName(customers).distinct(), ["k"], "v")


@query("""
SELECT r_name, count(*)::BIGINT AS n_nations, string_agg(n_name, ',' ORDER BY n_name) AS owners FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def incoming_edges(spark, sf):
    edges = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return edges.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_nations"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("owners"))


@query("""
WITH c AS (SELECT c_nationkey AS node, count(*) AS found FROM customer GROUP BY 1), d AS (SELECT n_nationkey AS node, 60 + n_nationkey % 2 AS declared FROM nation)
SELECT 'n' || node AS node, declared::INTEGER AS declared, coalesce(found, 0)::BIGINT AS found FROM d LEFT JOIN c USING (node) WHERE coalesce(found, 0) <> declared""")
def declared_counts(spark, sf):
    declared = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), (60 + F.col("n_nationkey") % 2).alias("declared"))
    edges = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return TR.declared_counts(declared, TR.descendant_counts(edges))


@query("""
SELECT doc_id, (doc_id % octet_length(encode(text)))::INTEGER AS changed_at, 1 AS n_changed FROM documents WHERE text <> ''""")
def one_byte_mutations(spark, sf):
    """One byte of each text is changed; the proof is the list of positions that differ."""
    docs = table(spark, sf, "documents").where("text != ''").select("doc_id", F.encode("text", "UTF-8").alias("a"))
    at = F.pmod(F.col("doc_id"), F.octet_length("a")).cast("int")
    one, two = F.unhex(F.lit("01")), F.unhex(F.lit("02"))
    byte = F.when(F.substring("a", at + 1, F.lit(1)) == one, two).otherwise(one)
    mutant = F.concat(F.substring("a", F.lit(1), at), byte, F.substring("a", at + 2, F.octet_length("a")))
    # Both are bound once for each text, not for each of its bytes.
    changed = docs.select("doc_id", F.get(F.transform(F.array(F.struct("a", mutant.alias("b"))), lambda x: S.positions_differing(x["a"], x["b"])), F.lit(0)).alias("p"))
    return changed.select("doc_id", F.get("p", F.lit(0)).alias("changed_at"), F.size("p").alias("n_changed"))


@query("""
WITH c AS (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS tags, html FROM pages) SELECT page_id, len(tags)::INTEGER AS n_tags, len(list_distinct(tags))::INTEGER AS n_kinds, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM c""")
def markup_inventory(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(tags).alias("n_tags"), F.size(F.array_distinct(tags)).alias("n_kinds"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))

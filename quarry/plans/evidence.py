"""Queries of the engine's operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import identity, numbers, texts
from quarry.operators import aggregates as A
from quarry.operators import joins as J
from quarry.operators import models as M
from quarry.operators import rules as R
from quarry.operators import sequences as S
from quarry.operators import status as ST
from quarry.operators import trees as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n():
    return F.count(F.lit(1)).alias("n")


# ---------------------------------------------------------------- predicates and constraints


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents),
v AS (SELECT doc_id, unnest([CASE WHEN NOT (n_chars > 0) THEN 'size_positive' END, CASE WHEN NOT (length(text) = n_chars) THEN 'size_declared' END,
  CASE WHEN NOT (lang IN ('en','fr','de')) THEN 'lang_known' END, CASE WHEN NOT (n_chars < 20000) THEN 'size_bounded' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source_form' END]) AS rule FROM d)
SELECT doc_id, rule FROM v WHERE rule IS NOT NULL UNION ALL SELECT doc_id, 'duplicate_text' FROM d WHERE nth > 1""")
def catalog_violations(spark, sf):
    docs = table(spark, sf, "documents")
    rules = [R.Rule("size_positive", F.col("n_chars") > 0), R.Rule("size_declared", F.length("text") == F.col("n_chars")), R.Rule("lang_known", F.col("lang").isin("en", "fr", "de")), R.Rule("size_bounded", F.col("n_chars") < 20000), R.Rule("source_form", F.col("source").rlike("^src[0-9]$"))]
    later = R.later_duplicates(docs.select("doc_id", F.sha2("text", 256).alias("sha256")), ["sha256"], ["doc_id"])
    return R.violations(docs, ["doc_id"], rules).unionByName(later.select("doc_id", F.lit("duplicate_text").alias("rule")))


@query("""
SELECT doc_id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1""")
def later_duplicate_rows(spark, sf):
    return R.later_duplicates(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), ["sha256"], ["doc_id"])


@query("""
SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*)::BIGINT AS n_aliases FROM documents GROUP BY text""")
def dedupe_keep_first(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_aliases"))


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS path FROM pages)
SELECT page_id, path, length(path) > 0 AND NOT regexp_matches(path, '[\\\\:]') AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS canonical FROM p""")
def relative_paths(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("path"))
    return pages.withColumn("canonical", R.relative_path(F.col("path")))


@query("""
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'NOT_RUN' WHEN event_type <> 'error' THEN 'PASS' WHEN value > 50 THEN 'UNSUPPORTED' ELSE 'FAIL' END AS status FROM events""")
def conversion_status(spark, sf):
    code = F.when(F.col("event_type") == "signup", F.lit(None).cast("int")).when(F.col("event_type") == "error", 1).otherwise(0)
    diagnostic = F.when(F.col("value") > 50, "format not supported").otherwise("crash")
    return table(spark, sf, "events").select("event_id", ST.conversion(code, diagnostic, ["not supported", "unsupported"]).alias("status"))


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_valid(props) AS valid FROM events""")
def metadata_fields(spark, sf):
    parsed = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"), parsed.isNotNull().alias("valid"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'OUT_OF_SCOPE' ELSE 'SELECTED' END AS scope FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def selected_and_out_of_scope(spark, sf):
    return J.partition_selected(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "scope")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 OR l_shipdate > TIMESTAMP '1998-01-01' OR l_quantity < 1 THEN 'FAIL' ELSE 'PASS' END AS status,
  l_discount <= 0.05 AS discount_ok, l_shipdate <= TIMESTAMP '1998-01-01' AS dates_ok, l_quantity >= 1 AS quantity_ok FROM lineitem""")
def check_vector(spark, sf):
    checks = {"discount_ok": F.col("l_discount") <= 0.05, "dates_ok": F.col("l_shipdate") <= F.lit("1998-01-01").cast("timestamp_ntz"), "quantity_ok": F.col("l_quantity") >= 1}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ST.verdict(F.lit(True), *checks.values()).alias("status"), *[c.alias(k) for k, c in checks.items()])


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'UNAVAILABLE' ELSE 'OBSERVED' END AS status, CASE WHEN value < 20 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN status = 'UNAVAILABLE' THEN v IS NULL ELSE v IS NOT NULL AND v <= 150 END AS holds FROM t""")
def tagged_observations(spark, sf):
    v = F.when(F.col("value") >= 20, F.col("value"))
    status = F.when(F.col("event_type") == "view", "UNAVAILABLE").otherwise("OBSERVED")
    return table(spark, sf, "events").select("event_id", R.observed(status, v, F.coalesce(v <= 150, F.lit(False))).alias("holds"))


@query("""
SELECT p_partkey, p_retailprice::DECIMAL(18,2)::VARCHAR AS text, true AS valid FROM part UNION ALL SELECT p_partkey, p_name, false FROM part""")
def decimal_domain(spark, sf):
    part = table(spark, sf, "part")
    both = part.select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("text")).unionByName(part.select("p_partkey", F.col("p_name").alias("text")))
    return both.withColumn("valid", R.decimal_text(F.col("text")))


# ---------------------------------------------------------------- joins and set operations


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_historical_default(spark, sf):
    return J.left_with_default(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], {"quality": -1, "toxic": -1})


@query("""
WITH a AS (SELECT o_orderkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS r FROM lineitem GROUP BY 1), j AS (SELECT l, r FROM a FULL JOIN b USING (k))
SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL)::BIGINT AS matched, count(*) FILTER (r IS NULL)::BIGINT AS missing, count(*) FILTER (l IS NULL)::BIGINT AS extra,
  count(*) FILTER (l > 1)::BIGINT AS repeated_left, count(*) FILTER (r > 1)::BIGINT AS repeated_right FROM j""")
def bijection_guard(spark, sf):
    return J.bijection(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("""
SELECT n_name, p_type, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def five_way_key_join(spark, sf):
    t = lambda name: table(spark, sf, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "p_type").agg(n(), F.sum("l_quantity").cast("double").alias("quantity"))


_A = "SELECT l_orderkey AS k, count(*) AS c, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1"


def _snapshot(spark, sf, status):
    return table(spark, sf, "lineitem").where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))


@query(f"""
WITH a AS ({_A}), b AS ({_A.replace("'O'", "'F'")}), j AS (SELECT k, a.c AS ac, b.c AS bc, a.q AS aq, b.q AS bq FROM a FULL JOIN b USING (k)),
c AS (SELECT *, CASE WHEN bc IS NULL THEN 'MISSING' WHEN ac IS NULL THEN 'ADDED' WHEN ac IS DISTINCT FROM bc OR aq IS DISTINCT FROM bq THEN 'CHANGED' ELSE 'SAME' END AS change FROM j)
SELECT k, change, CASE WHEN change <> 'CHANGED' THEN '' ELSE concat_ws(',', CASE WHEN ac IS DISTINCT FROM bc THEN 'c' END, CASE WHEN aq IS DISTINCT FROM bq THEN 'q' END) END AS columns FROM c""")
def full_outer_three_way_diff(spark, sf):
    return J.full_outer_diff(_snapshot(spark, sf, "O"), _snapshot(spark, sf, "F"), ["k"], ["c", "q"]).withColumn("columns", F.array_join("columns", ","))


_EV = ["event_id", "ts", "user_id", "event_type", "value"]


@query("""
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.ts < b.ts AND b.ts <= a.ts + INTERVAL 1 DAY""")
def temporal_pairs(spark, sf):
    events = table(spark, sf, "events").select(*_EV)
    pairs = J.temporal_pairs(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), ["user_id"], "ts", F.expr("INTERVAL 1 DAY"), width=86400)
    return pairs.select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase"))


@query("""
WITH m AS (SELECT p.event_id AS purchase, c.event_id AS click, c.ts AS cts, p.ts AS pts FROM (FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts)
SELECT purchase, CASE WHEN pts <= cts + INTERVAL 6 HOUR THEN click END AS click FROM m""")
def asof_tolerance(spark, sf):
    events = table(spark, sf, "events").select(*_EV)
    found = J.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), ["user_id"], "ts", "event_id", F.expr("INTERVAL 6 HOURS"))
    return found.select(F.col("a.event_id").alias("purchase"), F.col("b.event_id").alias("click"))


@query("""
WITH l AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS lifetime FROM events)
SELECT user_id, lifetime, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM l WHERE lifetime > 0 AND event_type <> 'signup' GROUP BY ALL""")
def lifetime_binding(spark, sf):
    bound = J.lifetimes(table(spark, sf, "events").select(*_EV), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return bound.where("lifetime > 0 AND event_type != 'signup'").groupBy("user_id", "lifetime").agg(n(), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH l AS (SELECT *, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS live FROM events)
SELECT user_id, arg_max(live, (ts, event_id)) AS live_at_end, min(live)::BIGINT AS lowest, count(*) FILTER (live < 0)::BIGINT AS violations FROM l GROUP BY user_id""")
def refcount_live_at_end(spark, sf):
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    live = J.live_count(table(spark, sf, "events").select(*_EV), ["user_id"], ["ts", "event_id"], delta)
    return live.groupBy("user_id").agg(F.max_by("live", F.struct("ts", "event_id")).alias("live_at_end"), F.min("live").alias("lowest"), F.count_if(F.col("live") < 0).alias("violations"))


@query("""
WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, length(text) AS l FROM a),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, length(text) AS l FROM conversations WHERE role = 'assistant')
SELECT conv_id, ord, coalesce(x.l <= b.l, false) AS equal FROM x FULL JOIN b USING (conv_id, ord)""")
def positional_join(spark, sf):
    from pyspark.sql import Window

    turns = table(spark, sf, "conversations").withColumn("ord", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")).select("conv_id", "ord", "role", F.length("text").alias("l"))
    side = lambda role: turns.where(F.col("role") == role).drop("role")
    return J.positional(side("user"), side("assistant"), ["conv_id"], "ord", lambda a, b: a["l"] <= b["l"])


@query("""
SELECT p_brand, count(DISTINCT p_type)::BIGINT AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1 UNION ALL SELECT p_type, count(DISTINCT p_brand)::BIGINT FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def mapping_agreement(spark, sf):
    part = table(spark, sf, "part")
    return J.agree(part, ["p_brand"], "p_type").unionByName(J.agree(part.select(F.col("p_type").alias("p_brand"), F.col("p_brand").alias("v")), ["p_brand"], "v"))


@query("""
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000""")
def selected_minus_found(spark, sf):
    """Customers without a large finished order."""
    found = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 250000")
    return table(spark, sf, "customer").select("c_custkey").subtract(found.select(F.col("o_custkey").alias("c_custkey")))


@query("""
SELECT l_suppkey AS k, 'no_part' AS which FROM lineitem EXCEPT ALL SELECT s_suppkey, 'no_part' FROM supplier""")
def key_sets_differ(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit("no_part").alias("which")).exceptAll(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("no_part").alias("which")))


@query("""
SELECT s, bool_or(e) AS expected, bool_or(a) AS authored FROM (SELECT doc_id % 97 AS s, true AS e, NULL AS a FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id % 97, NULL, true FROM documents WHERE lang = 'fr' UNION ALL SELECT unnest(range(97)), NULL, NULL) GROUP BY s""")
def slot_partition(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 97).alias("s"), F.when(F.col("lang") == "en", True).alias("expected"), F.when(F.col("lang") == "fr", True).alias("authored")).where("expected OR authored")
    slots = spark.range(97).select(F.col("id").alias("s"), F.lit(None).cast("boolean").alias("expected"), F.lit(None).cast("boolean").alias("authored"))
    return docs.unionByName(slots).groupBy("s").agg(F.bool_or("expected").alias("expected"), F.bool_or("authored").alias("authored"))


# ---------------------------------------------------------------- aggregations


@query("""
SELECT 'priority' AS histogram, o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY ALL UNION ALL SELECT 'size', p_size::VARCHAR, count(*)::BIGINT FROM part GROUP BY ALL""")
def histogram_rows(spark, sf):
    a = A.histogram(table(spark, sf, "orders").withColumn("histogram", F.lit("priority")), ["histogram"], F.col("o_orderpriority"))
    return a.unionByName(A.histogram(table(spark, sf, "part").withColumn("histogram", F.lit("size")), ["histogram"], F.col("p_size").cast("string")))


@query("""
SELECT p_type, string_agg(p_size || ':' || n, ',' ORDER BY p_size) AS bars, min(p_size) AS lowest, max(p_size) AS highest FROM (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type""")
def histogram_map(spark, sf):
    maps = A.histogram_map(A.histogram(table(spark, sf, "part"), ["p_type"], F.col("p_size")), ["p_type"])
    entries = F.map_entries("histogram")
    return maps.select("p_type", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("bars"), F.array_min(F.map_keys("histogram")).alias("lowest"), F.array_max(F.map_keys("histogram")).alias("highest"))


@query("""
SELECT l_returnflag, count(*) FILTER (l_discount = 0)::BIGINT AS no_discount, count(*) FILTER (l_tax > 0.05)::BIGINT AS taxed, count(*) FILTER (l_quantity >= 25)::BIGINT AS bulk, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def conditional_counters(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*A.counters({"no_discount": F.col("l_discount") == 0, "taxed": F.col("l_tax") > 0.05, "bulk": F.col("l_quantity") >= 25}), n())


@query("""
SELECT r_name, n_name, (2 - grouping(r_name) - grouping(n_name))::INTEGER AS grain, count(*)::BIGINT AS n, round(sum(c_acctbal), 2)::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def multi_grain_counts(spark, sf):
    t = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.grains(t, ["r_name", "n_name"], n=F.count(F.lit(1)), balance=F.round(F.sum("c_acctbal"), 2).cast("double"))


@query("""
SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS shortest, arg_max(doc_id, (n_chars, -doc_id)) AS longest, sum(n_chars)::BIGINT AS total, max(n_chars) AS most FROM documents GROUP BY 1""")
def arg_extremes(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(A.arg_min(F.col("doc_id"), F.col("n_chars"), F.col("doc_id")).alias("shortest"), A.arg_max(F.col("doc_id"), F.col("n_chars"), F.col("doc_id")).alias("longest"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("most"))


@query("""
WITH p AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT 'p_brand->p_type' AS direction, count(*)::BIGINT AS n_values, max(c) = 1 AS determines FROM (SELECT count(*) AS c FROM p GROUP BY p_brand)
UNION ALL SELECT 'p_type->p_brand', count(*)::BIGINT, max(c) = 1 FROM (SELECT count(*) AS c FROM p GROUP BY p_type)""")
def fd_test(spark, sf):
    return A.dependence(table(spark, sf, "part"), "p_brand", "p_type")


@query("""
SELECT lang, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.9), 3) AS p90, round(quantile_cont(n_chars, 0.95), 3) AS p95, round(quantile_cont(n_chars, 0.99), 3) AS p99, max(n_chars)::DOUBLE AS largest, count(*) FILTER (n_chars > 4000)::BIGINT AS above FROM documents GROUP BY 1""")
def exact_quantiles(spark, sf):
    q = table(spark, sf, "documents").groupBy("lang").agg(A.exact_quantiles(F.col("n_chars"), [0.5, 0.9, 0.95, 0.99]).alias("q"), F.max("n_chars").cast("double").alias("largest"), F.count_if(F.col("n_chars") > 4000).alias("above"))
    return q.select("lang", *[F.round(F.col("q")[i], 3).alias(c) for i, c in enumerate(("p50", "p90", "p95", "p99"))], "largest", "above")


@query("""
SELECT d.source, CASE max(CASE WHEN l.doc_id IS NULL THEN 2 WHEN l.toxic = 1 THEN 3 WHEN l.quality = 0 THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'NOT_RUN' WHEN 1 THEN 'UNSUPPORTED' ELSE 'PASS' END AS status, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def status_fold(spark, sf):
    status = F.when(F.col("quality").isNull(), ST.NOT_RUN).when(F.col("toxic") == 1, ST.FAIL).when(F.col("quality") == 0, ST.UNSUPPORTED).otherwise(ST.PASS)
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(ST.fold(status).alias("status"), n())


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'UNAVAILABLE' WHEN d.lang NOT IN ('en', 'fr') THEN 'INCOMPARABLE' WHEN l.quality <> 1 THEN 'DIFFERENT' ELSE 'EQUAL' END AS outcome, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def outcome_counts(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.groupBy(ST.outcome(F.col("quality") == 1, F.col("lang").isin("en", "fr"), F.col("quality").isNotNull()).alias("outcome")).agg(n())


@query("""
SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn) || chr(10)) AS sha256, count(*)::BIGINT AS n FROM conversations GROUP BY 1""")
def ordered_hash_agg(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(A.ordered_sha256(F.concat_ws(":", "role", "text"), F.col("turn")).alias("sha256"), n())


@query("""
WITH h AS (SELECT lang, hex(encode(text)) AS h FROM documents), c AS (SELECT lang, unnest(list_transform(range(0, length(h) // 2), lambda i: h[2 * i + 1:2 * i + 2])) AS s FROM h), k AS (SELECT lang, s, count(*) AS n FROM c GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM k GROUP BY lang""")
def byte_entropy(spark, sf):
    return A.byte_entropy(table(spark, sf, "documents"), ["lang"], F.encode("text", "UTF-8")).withColumn("entropy", F.round("entropy", 6))


@query("""
WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS s FROM documents) SELECT lang, count(*)::BIGINT AS n_distinct, string_agg(s, '' ORDER BY s) AS characters FROM c WHERE s <> '' GROUP BY lang""")
def code_point_inventory(spark, sf):
    each = table(spark, sf, "documents").select("lang", F.explode(texts.code_points(F.col("text"))).alias("s")).distinct()
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n_distinct"), F.array_join(F.array_sort(F.collect_list("s")), "").alias("characters"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS sum_disc_price, round(avg(l_discount), 6)::DOUBLE AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).cast("double").alias("avg_disc"), n())


# ---------------------------------------------------------------- windows and sequences


@query("""
SELECT conv_id, count(*)::BIGINT AS rows, count(DISTINCT turn)::BIGINT AS "distinct", min(turn) AS lowest, max(turn) AS highest, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) - min(turn) + 1 = count(*) AS complete FROM conversations GROUP BY 1""")
def sequence_gap_check(spark, sf):
    return S.sequence_faults(table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER % 4 AS level FROM lineitem) SELECT * FROM l QUALIFY level > lag(level, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, level) + 1""")
def level_rule(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("int") % 4).alias("level"))
    return S.level_faults(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "level"], "level")


@query("""
WITH p AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, length(text) - length(lag(text) OVER w) AS growth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, growth::INTEGER AS growth FROM p WHERE role = 'assistant' AND before = 'user'""")
def adjacent_pairing(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("l", F.length("text"))
    return S.adjacent(turns, ["conv_id"], ["turn"], ["role", "l"]).where("role = 'assistant' AND before.role = 'user'").select("conv_id", "turn", (F.col("l") - F.col("before.l")).alias("growth"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS last_view, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS last_click FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward_state(spark, sf):
    v = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return S.carry_forward(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"last_view": v("view"), "last_click": v("click")}).select("event_id", "last_view", "last_click")


@query("""
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM g""")
def resettable_registers(spark, sf):
    view = F.when(F.col("event_type") == "view", F.col("value"))
    return S.resettable(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"last_view": view}, F.col("event_type") == "error").select("event_id", "last_view")


@query("""
WITH i AS (SELECT l_suppkey, l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS b, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + (l_quantity::INTEGER % 9) AS e, l_partkey FROM lineitem),
s AS (SELECT *, b - max(e) OVER (PARTITION BY l_suppkey ORDER BY b, e, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM i)
SELECT l_suppkey, l_orderkey, l_linenumber, gap::INTEGER AS gap FROM s WHERE gap > 0""")
def interval_sweep_gaps(spark, sf):
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", day.alias("b"), (day + F.col("l_quantity").cast("int") % 9).alias("e"))
    return S.sweep(spans, ["l_suppkey"], "b", "e", ["l_orderkey", "l_linenumber", "l_partkey"]).where("gap > 0").select("l_suppkey", "l_orderkey", "l_linenumber", "gap")


@query("""
WITH s AS (SELECT doc_id, shelf, doc_id - row_number() OVER (PARTITION BY shelf ORDER BY doc_id) AS g FROM (SELECT DISTINCT doc_id, doc_id // 1000 AS shelf FROM labels))
SELECT shelf, min(doc_id) AS start, count(*)::BIGINT AS length FROM s GROUP BY shelf, g""")
def islands(spark, sf):
    shelves = table(spark, sf, "labels").select("doc_id", F.floor(F.col("doc_id") / 1000).alias("shelf"))
    return S.islands(shelves, ["shelf"], "doc_id")


@query("""
WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)
SELECT conv_id, len(roles) % 2 = 0 AND len(list_filter(range(len(roles)), lambda i: roles[i + 1] <> ['user', 'assistant'][i % 2 + 1])) = 0 AS cyclic FROM r""")
def cyclic_match(spark, sf):
    roles = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("roles"))
    return roles.select("conv_id", S.cyclic_match(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("cyclic"))


@query("""
WITH p AS (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS b FROM conversations)
SELECT conv_id, turn, coalesce(list_filter(range(least(len(a), len(b))), lambda i: a[i + 1] <> b[i + 1])[1], CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END)::INTEGER AS at FROM p WHERE b IS NOT NULL""")
def first_difference(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("w", F.split("text", " "))
    both = S.adjacent(turns, ["conv_id"], ["turn"], ["w"]).where("before IS NOT NULL")
    return both.select("conv_id", "turn", S.first_difference(F.col("w"), F.col("before.w")).alias("at"))


@query("""
SELECT l_orderkey, l_linenumber, ((l_partkey - l_suppkey) % 4294967296 + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647 AS newer FROM lineitem""")
def wraparound_order(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.newer(F.col("l_partkey"), F.col("l_suppkey")).alias("newer"))


@query("""
SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) = range(1, count(*) + 1) AS covered, list(l_partkey ORDER BY l_linenumber, l_partkey) = list_sort(list_distinct(list(l_partkey))) AS increasing FROM lineitem GROUP BY 1""")
def coverage_and_order(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    return rows.select("l_orderkey", S.covers(F.transform("r", lambda x: x["l_linenumber"].cast("long")), F.size("r")).alias("covered"), S.strictly_increasing(F.transform("r", lambda x: x["l_partkey"])).alias("increasing"))


# ---------------------------------------------------------------- order and limits


@query("""
SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, lang DESC, doc_id LIMIT 25""")
def multi_key_top(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), F.desc("lang"), "doc_id").limit(25)


@query("""
SELECT source, doc_id FROM documents WHERE lang = 'de' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 16""")
def first_failures(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").where("lang = 'de'").select("source", "doc_id")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("_n <= 16").drop("_n")


@query("""
SELECT page_id, regexp_extract(url, '/([0-9]+)', 1)::INTEGER AS suffix FROM pages WHERE regexp_matches(url, '/[0-9]+') ORDER BY suffix, page_id LIMIT 20""")
def numeric_suffix_order(spark, sf):
    pages = table(spark, sf, "pages").where(F.col("url").rlike("/[0-9]+")).select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).cast("int").alias("suffix"))
    return pages.orderBy("suffix", "page_id").limit(20)


# ---------------------------------------------------------------- functions


@query("""
SELECT doc_id, octet_length(encode(text))::INTEGER AS size, sha256(text) AS sha256, sha256(array_to_string(string_split(text, '')[1:10], '')) AS head FROM documents""")
def content_identity(spark, sf):
    docs = table(spark, sf, "documents").withColumn("i", identity.text_identity(F.col("text")))
    return docs.select("doc_id", "i.size", "i.sha256", F.sha2(F.substring("text", 1, 10).cast("binary"), 256).alias("head"))


@query("""
SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS blob_sha1 FROM documents""")
def git_blob_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", identity.git_blob_sha1(F.encode("text", "UTF-8")).alias("blob_sha1"))


@query("""
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' || chr(10)) AS sha256 FROM documents""")
def canonical_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", identity.value_sha256({c: F.col(c) for c in ("n_chars", "lang", "doc_id")}).alias("sha256"))


@query("""
SELECT doc_id, length(text)::INTEGER AS code_points, octet_length(encode(text))::INTEGER AS bytes, (length(text) - length(replace(text, 'e', '')))::INTEGER AS e, (length(text) - length(replace(text, ' ', '')))::INTEGER AS blanks, len(regexp_extract_all(text, '([0-9]+)'))::INTEGER AS digit_runs FROM documents""")
def text_evidence(spark, sf):
    docs = table(spark, sf, "documents")
    seen, covered = texts.evidence(F.col("text")), texts.coverage(F.col("text"), "e ")
    return docs.select("doc_id", seen["code_points"].alias("code_points"), seen["bytes"].alias("bytes"), covered["e"].alias("e"), covered[" "].alias("blanks"), F.size(texts.digit_runs(F.col("text"))).alias("digit_runs"))


@query("""
SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN floor(p_retailprice)::BIGINT::VARCHAR ELSE rtrim(p_retailprice::DECIMAL(18,2)::VARCHAR, '0') END AS text FROM part""")
def number_texts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.number_text(F.col("p_retailprice").cast("decimal(18,2)")).alias("text"))


@query("""
SELECT x.vec_id, round(list_max(list_transform(range(1, len(x.embedding) + 1), lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE))), 6) AS residual FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id - 1""")
def vector_residual(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b"))
    return vectors.join(before, "vec_id", "left").select("vec_id", F.round(numbers.residual(F.col("a"), F.col("b")), 6).alias("residual"))


@query("""
SELECT l_orderkey, l_linenumber, bit_count(xor(l_partkey, l_suppkey))::INTEGER AS bits, ((l_partkey >> 3) & 31)::INTEGER AS field FROM lineitem""")
def bit_fields(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.bit_difference(F.col("l_partkey"), F.col("l_suppkey")).alias("bits"), numbers.bit_field(F.col("l_partkey"), 3, 5).cast("int").alias("field"))


@query("""
SELECT p_partkey, unnest(range(ceil(p_size / 7.0)::BIGINT)) * 7 AS at FROM part""")
def span_repetition(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(numbers.repeats(F.col("p_size"), F.lit(7))).alias("at")).withColumn("at", F.col("at").cast("long"))


@query("""
SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def html_link_inventory(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


# ---------------------------------------------------------------- trees and references


def _edges(spark, sf):
    edge = lambda parent, node: [F.concat_ws(":", *parent).alias("parent"), F.concat_ws(":", *node).alias("node")]
    nation = table(spark, sf, "nation").select(*edge([F.lit("r"), "n_regionkey"], [F.lit("n"), "n_nationkey"]))
    customer = table(spark, sf, "customer").select(*edge([F.lit("n"), "c_nationkey"], [F.lit("c"), "c_custkey"]))
    return nation.unionByName(customer).unionByName(table(spark, sf, "region").select(*edge([F.lit("root")], [F.lit("r"), "r_regionkey"])))


_EDGES = "SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS node FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'root', 'r:' || r_regionkey FROM region"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), t(ancestor, node) AS (SELECT parent, node FROM e UNION ALL SELECT t.ancestor, e.node FROM t JOIN e ON e.parent = t.node)
SELECT ancestor, count(*)::BIGINT AS n_descendants FROM t GROUP BY 1""")
def descendant_counts(spark, sf):
    return TR.descendant_counts(_edges(spark, sf))


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), t(ancestor, node, distance) AS (SELECT parent, node, 1 FROM e UNION ALL SELECT t.ancestor, e.node, t.distance + 1 FROM t JOIN e ON e.parent = t.node) SELECT * FROM t""")
def ancestor_pairs(spark, sf):
    return TR.ancestors(_edges(spark, sf))


@query("""
SELECT l.doc_id FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang <> 'es') d USING (doc_id)""")
def dangling_refs(spark, sf):
    return TR.dangling(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("lang != 'es'").select(F.col("doc_id").alias("id")), "doc_id", "id")


@query("""
SELECT conv_id * 1000 + turn AS node, CASE WHEN EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn + 1 AND (x.conv_id + x.turn) % 7 = 0) THEN 'FAIL' ELSE 'PASS' END AS status FROM conversations c""")
def sibling_backlinks(spark, sf):
    """Turns as siblings; every seventh points back to a turn that is not the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    node = F.col("conv_id") * 1000 + F.col("turn")
    turns = table(spark, sf, "conversations")
    previous = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, node + 500).otherwise(F.lag(node).over(w))
    return TR.backlinks(turns.select(node.alias("node"), previous.alias("previous"), F.lead(node).over(w).alias("next")))


@query("""
WITH a AS (SELECT user_id, event_id // 2 AS pair, json_extract_string(props, '$.k') AS value, event_id % 2 AS side FROM events)
SELECT x.pair, '$.k' AS path, sha256(x.value) AS before, sha256(y.value) AS after FROM a x JOIN a y ON x.pair = y.pair AND x.side = 0 AND y.side = 1 WHERE x.value IS DISTINCT FROM y.value""")
def nested_value_diff(spark, sf):
    leaves = table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2).alias("side"), F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    leaves = leaves.select("pair", "side", F.concat(F.lit("$."), "name").alias("path"), "value")
    return TR.changed_leaves(leaves.where("side = 0").drop("side"), leaves.where("side = 1").drop("side"), ["pair"])


# ---------------------------------------------------------------- models


@query("""
WITH h AS (SELECT l_returnflag, unnest(['price_by_part', 'flat', 'by_quantity']) AS hypothesis, unnest([abs(l_quantity * p_retailprice - l_extendedprice), abs(l_extendedprice - 30000), abs(l_quantity * 1000 - l_extendedprice)]) AS error FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_returnflag, hypothesis, count(*)::BIGINT AS rows, count(*) FILTER (error <= 500)::BIGINT AS matches, round(max(error), 2)::DOUBLE AS max_error FROM h GROUP BY ALL""")
def hypothesis_evaluation(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = {"price_by_part": F.col("l_quantity") * F.col("p_retailprice"), "flat": F.lit(30000.0), "by_quantity": F.col("l_quantity") * 1000}
    return M.hypotheses(rows, ["l_returnflag"], said, F.col("l_extendedprice"), 500).withColumn("max_error", F.round("max_error", 2))


@query("""
SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1""")
def affine_fit(spark, sf):
    fitted = M.affine_fit(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity"], "l_extendedprice")
    return fitted.select("l_returnflag", F.round(F.col("coefficients")[0], 4).alias("intercept"), F.round(F.col("coefficients")[1], 4).alias("slope"), "rows")


@query("""
WITH m AS (SELECT l_linestatus AS g, count(*)::BIGINT AS rows, avg(l_quantity::DOUBLE) AS ma, avg(l_discount::DOUBLE) AS mb, avg(l_tax::DOUBLE) AS mc, avg(l_extendedprice::DOUBLE) AS my,
  var_pop(l_quantity::DOUBLE) AS aa, var_pop(l_discount::DOUBLE) AS bb, var_pop(l_tax::DOUBLE) AS cc, covar_pop(l_quantity::DOUBLE, l_discount::DOUBLE) AS ab, covar_pop(l_quantity::DOUBLE, l_tax::DOUBLE) AS ac, covar_pop(l_discount::DOUBLE, l_tax::DOUBLE) AS bc,
  covar_pop(l_quantity::DOUBLE, l_extendedprice::DOUBLE) AS ay, covar_pop(l_discount::DOUBLE, l_extendedprice::DOUBLE) AS by_, covar_pop(l_tax::DOUBLE, l_extendedprice::DOUBLE) AS cy FROM lineitem GROUP BY 1),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS s1, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS s2,
  (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS s3 FROM d)
SELECT g AS l_linestatus, round(my - s1 * ma - s2 * mb - s3 * mc, 3) AS intercept, round(s1, 3) AS quantity, round(s2, 3) AS discount, round(s3, 3) AS tax, rows FROM s""")
def affine_fit_three(spark, sf):
    """Three features; the SQL solves the normal equations by determinants."""
    fitted = M.affine_fit(table(spark, sf, "lineitem"), "l_linestatus", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return fitted.select("l_linestatus", *[F.round(F.col("coefficients")[i], 3).alias(c) for i, c in enumerate(("intercept", "quantity", "discount", "tax"))], "rows")


_MUTANTS = ["same", "stream", "moved", "both", "fewer"]


@query("""
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS x FROM orders),
m AS (SELECT k, unnest(['same', 'stream', 'moved', 'both', 'fewer']) AS mutant, s, x FROM b),
c AS (SELECT mutant, k % 10 = 3 AND mutant IN ('stream', 'both') AS s, k % 10 = 4 AND mutant IN ('moved', 'both') AS x, k % 10 = 5 AND mutant = 'fewer' AS gone FROM m),
n AS (SELECT mutant, count(*) FILTER (gone)::BIGINT AS unpaired, count(*) FILTER (x OR gone)::BIGINT AS moved, count(*) FILTER (s OR gone)::BIGINT AS changed FROM c GROUP BY 1)
SELECT *, CASE WHEN unpaired > 0 THEN 'COUNT_CHANGED' WHEN moved = 0 AND changed = 0 THEN 'IDENTICAL' WHEN moved = 0 THEN 'STREAM_ONLY' WHEN changed = 0 THEN 'TRANSLATION' ELSE 'OTHER' END AS outcome FROM n""")
def mutation_outcome(spark, sf):
    """Orders against five mutants of them, one for each outcome."""
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("x"))
    digit, out = F.col("k") % 10, None
    for name in _MUTANTS:
        mutant = base
        if name in ("stream", "both"):
            mutant = mutant.withColumn("s", F.when(digit == 3, "changed").otherwise(F.col("s")))
        if name in ("moved", "both"):
            mutant = mutant.withColumn("x", F.when(digit == 4, F.col("x") + 1).otherwise(F.col("x")))
        if name == "fewer":
            mutant = mutant.where(digit != 5)
        one = M.mutation_outcome(base, mutant, ["k"], "s", ["x"]).withColumn("mutant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out

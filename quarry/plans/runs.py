"""End-to-end runs: each composes the operators into one plan and ends in a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import audit as AU
from quarry.operators import joins as J
from quarry.operators import rules as R
from quarry.operators import sequences as S
from quarry.operators import status as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def conversion_report(catalog: DataFrame, history: DataFrame, attempts: DataFrame) -> DataFrame:
    """Catalog rows (sha256, size, declared_size, source), kept first by hash, with their history (sha256, expected) and attempt (sha256, code, diagnostic): counts of outcomes and the folded status by source."""
    first = Window.partitionBy("sha256").orderBy("ordinal")
    unique = catalog.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    known = J.left_with_default(unique, history, ["sha256"], {"expected": "unknown"})
    tried = known.join(attempts, "sha256", "left")
    intact = F.col("size") == F.col("declared_size")
    outcome = F.when(~intact, ST.FAIL).otherwise(ST.conversion(F.col("code"), F.col("diagnostic"), ["not supported"]))
    judged = tried.withColumn("outcome", F.when((F.col("expected") == "unsupported") & (outcome == ST.PASS), ST.FAIL).otherwise(outcome))
    counts = [F.count_if(F.col("outcome") == s).alias(s.lower()) for s in (ST.PASS, ST.FAIL, ST.NOT_RUN, ST.UNSUPPORTED)]
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("selected"), *counts, ST.fold(F.col("outcome")).alias("status"))


@query("""
WITH c AS (SELECT doc_id, text, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
j AS (SELECT c.source, CASE WHEN length(c.text) <> c.n_chars THEN 'FAIL' WHEN l.doc_id IS NULL THEN 'NOT_RUN' WHEN l.quality = 1 AND c.doc_id % 13 = 0 THEN 'FAIL' WHEN l.quality = 1 THEN 'PASS' WHEN l.toxic = 1 THEN 'UNSUPPORTED' ELSE 'FAIL' END AS o
      FROM c LEFT JOIN labels l USING (doc_id))
SELECT source, count(*)::BIGINT AS selected, count(*) FILTER (o = 'PASS')::BIGINT AS pass, count(*) FILTER (o = 'FAIL')::BIGINT AS fail, count(*) FILTER (o = 'NOT_RUN')::BIGINT AS not_run, count(*) FILTER (o = 'UNSUPPORTED')::BIGINT AS unsupported,
  CASE WHEN bool_or(o = 'FAIL') THEN 'FAIL' WHEN bool_or(o = 'NOT_RUN') THEN 'NOT_RUN' WHEN bool_or(o = 'UNSUPPORTED') THEN 'UNSUPPORTED' ELSE 'PASS' END AS status FROM j GROUP BY 1""")
def run_conversion_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"))
    firsts = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    labels = firsts.join(table(spark, sf, "labels"), "doc_id")
    history = firsts.where("doc_id % 13 = 0").select("sha256", F.lit("unsupported").alias("expected"))
    attempts = labels.select("sha256", F.when(F.col("quality") == 1, 0).otherwise(1).alias("code"), F.when(F.col("toxic") == 1, "profile not supported").otherwise("crash").alias("diagnostic"))
    return conversion_report(docs.select("sha256", "size", F.col("n_chars").alias("declared_size"), "source", F.col("doc_id").alias("ordinal")), history, attempts)


def parity_report(observed: DataFrame, baselines: list[tuple[str, DataFrame]], keys: list[str], checks: dict) -> DataFrame:
    """Observed rows against any number of baselines on one key, all partitioned by it once: attempted, matching and failing by check, and rows that a baseline lacks."""
    joined = observed
    for name, base in baselines:
        joined = joined.join(base.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias(name)), keys, "left")
    lacking = F.lit(False)
    for name, _ in baselines:
        lacking = lacking | F.col(name).isNull()
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.when(lacking, None).otherwise(c).alias("good")) for n, c in checks.items()]))
    return joined.select(each.alias("c")).groupBy(F.col("c.check").alias("check")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if("c.good").alias("matching"), F.count_if(~F.col("c.good")).alias("failing"), F.count_if(F.col("c.good").isNull()).alias("not_run"))


@query("""
WITH j AS (SELECT l.*, o.o_orderdate, o.o_orderpriority, p.p_retailprice, s.s_acctbal FROM (SELECT *, l_partkey % 1000 = 7 AS cut FROM lineitem) l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN part p ON l_partkey = p_partkey AND NOT cut LEFT JOIN supplier s ON l_suppkey = s_suppkey),
c AS (SELECT unnest(['dates', 'price', 'funds']) AS "check", unnest([CASE WHEN p_retailprice IS NULL THEN NULL ELSE l_shipdate >= o_orderdate END, CASE WHEN p_retailprice IS NULL THEN NULL ELSE l_extendedprice >= p_retailprice END, CASE WHEN p_retailprice IS NULL THEN NULL ELSE s_acctbal >= 0 END]) AS good FROM j)
SELECT "check", count(*)::BIGINT AS attempted, count(*) FILTER (good)::BIGINT AS matching, count(*) FILTER (NOT good)::BIGINT AS failing, count(*) FILTER (good IS NULL)::BIGINT AS not_run FROM c GROUP BY 1""")
def run_parity_report(spark, sf):
    t = lambda n: table(spark, sf, n)
    lines = t("lineitem")
    key = lambda df, c: df.withColumnRenamed(c, "_k")
    joined = lines.withColumnRenamed("l_orderkey", "_k").join(key(t("orders").select("o_orderkey", "o_orderdate"), "o_orderkey"), "_k", "left").withColumnRenamed("_k", "l_orderkey")
    joined = joined.withColumnRenamed("l_suppkey", "_k").join(key(t("supplier").select("s_suppkey", "s_acctbal"), "s_suppkey"), "_k", "left").drop("_k")
    parts = t("part").where("p_partkey % 1000 != 7").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    checks = {"dates": F.col("l_shipdate") >= F.col("o_orderdate"), "price": F.col("l_extendedprice") >= F.col("part.p_retailprice"), "funds": F.col("s_acctbal") >= 0}
    return parity_report(joined, [("part", parts)], ["l_partkey"], checks)


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS life FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, life, event_type, value FROM e WHERE event_type <> 'signup')
SELECT user_id % 10 AS resource, count(*)::BIGINT AS events, count(*) FILTER (life > 0)::BIGINT AS bound, count(DISTINCT event_type)::BIGINT AS kinds, count(DISTINCT CASE WHEN life > 0 THEN (user_id, life) END)::BIGINT AS lifetimes FROM g GROUP BY 1""")
def run_event_binding(spark, sf):
    """Events bound to the lifetime that is open, folded by resource."""
    bound = J.lifetimes(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    rest = bound.where("event_type != 'signup'")
    life = F.when(F.col("lifetime") > 0, F.struct("user_id", "lifetime"))
    return rest.groupBy((F.col("user_id") % 10).alias("resource")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("lifetime") > 0).alias("bound"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(life).alias("lifetimes"))


@query("""
WITH p AS (SELECT page_id, url, html, page_id % 4 AS c FROM pages), f AS (SELECT c, page_id, regexp_matches(html, '<title>[^<]+</title>') AS titled, len(regexp_extract_all(html, '<p[ >]')) > 0 AS paragraphs, regexp_matches(url, '^https?://') AS addressed FROM p)
SELECT c AS "case", count(*)::BIGINT AS pages, count(*) FILTER (titled AND paragraphs AND addressed)::BIGINT AS pass, count(*) FILTER (NOT titled)::BIGINT AS untitled, count(*) FILTER (NOT paragraphs)::BIGINT AS no_paragraph, CASE WHEN bool_and(titled AND paragraphs AND addressed) THEN 'PASS' ELSE 'FAIL' END AS status FROM f GROUP BY 1""")
def run_geometry_report(spark, sf):
    """Page checks folded to a line for each case; a failing page is counted, not raised."""
    found = table(spark, sf, "pages").select((F.col("page_id") % 4).alias("case"), F.col("html").rlike("<title>[^<]+</title>").alias("titled"), F.col("html").rlike("<p[ >]").alias("paragraphs"), F.col("url").rlike("^https?://").alias("addressed"))
    good = ST.verdict(F.lit(True), F.col("titled"), F.col("paragraphs"), F.col("addressed"))
    return found.groupBy("case").agg(F.count(F.lit(1)).alias("pages"), F.count_if(good == ST.PASS).alias("pass"), F.count_if(~F.col("titled")).alias("untitled"), F.count_if(~F.col("paragraphs")).alias("no_paragraph"), ST.fold(good).alias("status"))


@query("""
WITH a AS (SELECT conv_id, turn, sha256(text) AS h, role FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'x' ELSE sha256(text) END AS h, role FROM conversations WHERE NOT (conv_id % 5 = 2 AND turn = 2)),
j AS (SELECT conv_id, CASE WHEN a.h IS NULL OR b.h IS NULL THEN 3 WHEN a.h <> b.h THEN 1 ELSE 4 END AS o FROM a FULL JOIN b USING (conv_id, turn))
SELECT conv_id, count(*) FILTER (o = 4)::BIGINT AS equal, count(*) FILTER (o = 1)::BIGINT AS different, count(*) FILTER (o = 3)::BIGINT AS unavailable, CASE WHEN bool_or(o = 1) THEN 'DIFFERENT' WHEN bool_or(o = 3) THEN 'UNAVAILABLE' ELSE 'EQUAL' END AS outcome FROM j GROUP BY 1""")
def run_fixture_diff(spark, sf):
    """Two versions of a bundle, position by position: DIFFERENT comes before UNAVAILABLE, and both before EQUAL."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    candidate = turns.where("NOT (conv_id % 5 = 2 AND turn = 2)").withColumn("h", F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), "x").otherwise(F.col("h")))
    seen = AU.stability(turns, candidate, ["conv_id", "turn"], "h")
    count = lambda s: F.count_if(F.col("status") == s)
    return seen.groupBy("conv_id").agg(count("STABLE").alias("equal"), count("UNSTABLE").alias("different"), count("NOT_CONFIRMED").alias("unavailable")).withColumn("outcome", F.when(F.col("different") > 0, "DIFFERENT").when(F.col("unavailable") > 0, "UNAVAILABLE").otherwise("EQUAL"))


@query("""
WITH s AS (SELECT l_suppkey % 20 AS shelf, l_orderkey * 10 AS a, l_orderkey * 10 + l_quantity::BIGINT AS b, l_linenumber, l_partkey FROM lineitem),
w AS (SELECT *, a - max(b) OVER (PARTITION BY shelf ORDER BY a, b, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM s)
SELECT shelf, count(*)::BIGINT AS spans, count(*) FILTER (gap > 0)::BIGINT AS gaps, count(*) FILTER (gap < 0)::BIGINT AS overlaps, coalesce(sum(CASE WHEN gap > 0 THEN gap END), 0)::BIGINT AS uncovered, count(*) FILTER (gap <> 0 OR gap IS NULL) = 1 AS exact FROM w GROUP BY 1""")
def run_span_accounting(spark, sf):
    """Every byte of a source accounted for: gaps and overlaps of its spans."""
    lines = table(spark, sf, "lineitem")
    spans = lines.select((F.col("l_suppkey") % 20).alias("shelf"), (F.col("l_orderkey") * 10).alias("a"), (F.col("l_orderkey") * 10 + F.col("l_quantity").cast("long")).alias("b"), "l_linenumber", "l_partkey")
    gap = F.col("gap")
    return S.sweep(spans, ["shelf"], "a", "b", ["l_linenumber", "l_partkey"]).groupBy("shelf").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(gap > 0).alias("gaps"), F.count_if(gap < 0).alias("overlaps"), F.coalesce(F.sum(F.when(gap > 0, gap)), F.lit(0)).alias("uncovered"), (F.count_if((gap != 0) | gap.isNull()) == 1).alias("exact"),
    )


@query("""
WITH d AS (SELECT doc_id, lang, n_chars, source FROM documents), r AS (SELECT doc_id, unnest([CASE WHEN lang NOT IN ('en','fr','de','es') THEN 'lang' END, CASE WHEN n_chars < 50 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END]) AS rule FROM d WHERE source <> 'src3' UNION ALL SELECT doc_id, 'source' FROM d WHERE source = 'src3')
SELECT rule, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM r WHERE rule IS NOT NULL GROUP BY 1""")
def run_manifest_validation(spark, sf):
    rules = [R.Rule("source", F.col("source") != "src3", guard=True), R.Rule("lang", F.col("lang").isin("en", "fr", "de", "es")), R.Rule("short", F.col("n_chars") >= 50), R.Rule("long", F.col("n_chars") <= 10000)]
    broken = R.violations(table(spark, sf, "documents"), ["doc_id"], rules)
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))

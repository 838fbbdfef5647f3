"""The queries opN_<name> over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, exact_dedup, licences, line_dedup, media, ngram_join, quality, sharding, spelling, token_counts, url_filter
from .common import materialise, table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 16


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as FLAC, decoded into PCM blocks that are written and read back for digests and features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.to_flac(media.padded(F.col("text"))).alias("media"))
    stored = materialise(docs.select("doc_id", "n_bytes", media.to_pcm(F.col("media")).alias("pcm")), "pcm")
    return stored.withColumn("f", media.pcm_features("pcm")).select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "pcm.media_bytes", "pcm.media_sha256", "f.feature")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, ["doc_id"], decoded=True)
    return coded.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).select(F.col("_doc").alias("doc_id"), "class_id", "n_links", "copy_of")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = licences.scan(docs, licences.train(licences.background_of(docs)))
    return scanned.select(F.col("row.doc_id").alias("doc_id"), *licences.summary(scanned))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("row.text").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_weight=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files of 2-byte ids, each ended by id 50256, which the vocabulary leaves free; the files are then read without knowing where documents end."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.count_by_document(token_counts.pack(table(spark, sf_dir, "documents"), ranks, separator=50256), separator=50256)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac": op1_flac,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_licences": op6_licences,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

_HOST = "translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op4_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN ['no words: ' || text] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: array_to_string(ws[k:k + 4], ' ')))) END AS gs FROM d),
k AS (SELECT row_number() OVER () AS k, * FROM (SELECT gs, count(*) AS size, min(doc_id) AS rep FROM g GROUP BY gs)),
p AS (SELECT k, len(gs) AS m, unnest(gs) AS gram FROM k),
l AS (SELECT a.k AS x, b.k AS y FROM p a JOIN p b ON a.gram = b.gram AND a.k <> b.k AND least(a.m, b.m) >= 0.8 * greatest(a.m, b.m) - 1e-9
      GROUP BY a.k, b.k HAVING count(*) >= 0.8 * (max(a.m) + max(b.m) - count(*)) - 1e-9),
r(x, y) AS (SELECT k, k FROM k UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x AS k, min(k.rep) AS class_id FROM r JOIN k ON r.y = k.k GROUP BY r.x),
n AS (SELECT l.x AS k, sum(k.size) AS n FROM l JOIN k ON l.y = k.k GROUP BY l.x)
SELECT doc_id, class_id, (size - 1 + coalesce(n, 0))::BIGINT AS n_links, rep AS copy_of FROM g JOIN k USING (gs) JOIN c USING (k) LEFT JOIN n USING (k)""",
    "op2_url_filter": f"""
WITH r(action, host, path) AS (VALUES {", ".join(repr(r) for r in URL_RULES)}),
u AS (SELECT row_number() OVER () AS n, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
f AS (SELECT u.n, min(struct_pack(o := -length(r.host || r.path), rule := r.host || r.path, action := r.action)) AS best
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM u LEFT JOIN f USING (n)""",
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORDS}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORDS}) AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS l, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k:k + 9], ' '))) AS g FROM i WHERE len(ws) > 0),
s AS (SELECT DISTINCT l FROM w),
g AS (SELECT n, l, unnest(range(1, len(ws) - l + 2)) AS p, unnest(list_transform(range(1, len(ws) - l + 2), lambda k: array_to_string(ws[k:k + l - 1], ' '))) AS g FROM d JOIN s ON len(ws) >= l),
h AS (SELECT n, p, l, item_id FROM g JOIN w USING (l, g)),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(p, p + l)) AS p FROM h) GROUP BY n),
ids AS (SELECT n, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT n, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN ids USING (n)""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT n, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT n) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE h.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY n, doc_id""",
    "op8_sharding": """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT n, doc_id, octet_length(encode(text)) + 1 AS size, hex(encode(text)) AS h,
      list_transform(range(17), lambda s: -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS bids FROM d),
p AS (SELECT *, list_position(bids[1:16], list_min(bids[1:16])) - 1 AS shard, bids[17] < list_min(bids[1:16]) AS moves FROM b),
c AS (SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS text_crc32,
       shard::INTEGER AS shard, (CASE WHEN moves THEN 16 ELSE shard END)::INTEGER AS grown_shard
FROM p, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), doc_id NULLS FIRST) - 1 AS slot
FROM c""",
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, k.c::HUGEINT AS all_c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER w + count(*) OVER w)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (all_c + 1)) // (sum(all_c) OVER w + count(*) OVER w)::HUGEINT AS q
      FROM a WINDOW w AS (PARTITION BY lang, source)),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200""",
    "op12_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE c AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {_LETTERS}) AS run FROM documents),
o AS (SELECT d, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY d, run),
x AS (SELECT run, n, hex(encode(d || ':' || run)) AS h FROM o),
s AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS crc FROM x, c),
z AS (SELECT CASE WHEN crc % 31 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, n FROM s),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM z WHERE length(word) >= 7 GROUP BY word HAVING sum(z.n) >= 2),
v AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, word[:i - 1] || word[i + 1:] AS less FROM w),
e AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.less = w.word),
b AS (SELECT e.word, count(*) AS n_near, max(w.n) AS top, (list(e.other ORDER BY w.n DESC, encode(e.other)))[1] AS best FROM e JOIN w ON e.other = w.word GROUP BY e.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
p(word, last) AS (SELECT word, word FROM f UNION SELECT p.word, f.form FROM p JOIN f ON p.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.last AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON f.word = p.word JOIN f l ON l.word = p.last WHERE l.form IS NULL""",
}

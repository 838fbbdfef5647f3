"""Exact dedup, source divergence and spelling variants against brute force, on nulls, empty texts, ties, repeats and hot keys."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, exact_dedup, spelling
from tests.llm.test_native import python_free

# ---------------------------------------------------------------- exact dedup


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = collections.Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda d: (d is not None, d or 0), reverse=True)
        for place, d in enumerate(ids):
            out[(d, ids[0], len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def copies(rng, n=600):
    texts = ["", None, "a", "a ", "A", "é", "long " * 2000] + [f"text {i}" for i in range(60)]
    rows = [(rng.choice([None, *range(200)]), rng.choice(texts)) for _ in range(n)] + [(7, "twice"), (7, "twice")]
    return rows + [(1000 + i % 150, "hot text") for i in range(300)]


@pytest.mark.parametrize(("key", "bucket"), [(F.xxhash64, 256 << 10), (F.xxhash64, 500), (lambda t: F.pmod(F.xxhash64(t), F.lit(3)), 2000), (lambda t: F.lit(5).cast("long"), 1000)])
def test_copies_against_brute_force(spark, key, bucket):
    rows = copies(random.Random(bucket))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(5)
    out = exact_dedup.dedup(docs, key=key, bucket_bytes=bucket, bits=8)
    got = collections.Counter((r["row"]["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect())
    assert got == brute_copies(rows)
    assert python_free(out)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in rows})
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_directory_covers_all_keys_once_and_splits_what_is_overfull(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of some length "), "id").alias("text"))
    keys = exact_dedup.keys_of(docs)
    directory, chains, depth = exact_dedup.directory_of(keys, bucket_bytes=4000, bits=10)
    slots = [r["slot"] for r in directory.collect()]
    assert len(slots) == len(set(slots)) and set(slots) <= set(range(1 << depth)) and chains.count() == 0
    load = keys.join(directory, F.shiftrightunsigned("key", 64 - depth) == F.col("slot")).groupBy("bucket").agg(F.sum("n_bytes").alias("load"), F.countDistinct("slot").alias("slots"))
    rows = load.collect()
    assert sum(r["load"] for r in rows) == sum(r["n_bytes"] for r in keys.collect()) and max(r["load"] for r in rows) <= 4000 and len(rows) > 50
    assert len({r["slots"] for r in rows}) > 1  # local depths differ


def test_a_hot_text_is_dealt_to_many_parts(spark):
    docs = spark.range(20_000, numPartitions=40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    keys = exact_dedup.keys_of(docs)
    _, chains, _ = exact_dedup.directory_of(keys, bucket_bytes=50_000)
    assert [r["parts"] for r in chains.collect()] == [14]
    found = exact_dedup.dedup(docs, bucket_bytes=50_000)
    row = found.where("group_size > 1 AND kept").select("row.doc_id", "keep_id", "group_size").collect()
    assert [tuple(r) for r in row] == [(19_998, 19_998, 6667)]


# ---------------------------------------------------------------- divergence


def brute_audit(rows, least, top):
    docs = [((x or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))) for x, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        n_docs = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in n_docs.items() if n >= least)
        counts = {s: collections.Counter(t for _, x, ts in own if x == s for t in ts if n_docs[t] >= least) for s in {d[1] for d in own}}
        whole = sum(counts.values(), collections.Counter())

        def levels(count, kept=kept):
            return {t: 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept)) for t in kept}

        p = {s: levels(c) for s, c in counts.items()}
        q = levels(whole)
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most])]
    return collections.Counter(out)


def audited_rows():
    rng = random.Random(3)
    words = ["Alpha", "alpha", "beta", "über", "x", "naïve", "日本", "don't", "a1b"] + [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s1", "s2", None, "", "é"]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)]
    rows += [("en", "hot", "alpha beta " * 200)] * 60 + [("fr", "only", "one two"), ("it", "a", None), ("it", "b", "123 - _"), ("en", "silent", "!!!"), ("en", "long", "beta " * 40_000)]
    return rows


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 4)])
def test_divergence_against_brute_force(spark, least, top):
    rows = audited_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(6)
    got = collections.Counter(tuple(r) for r in divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, least, top)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits_of_product(spark):
    rows = spark.createDataFrame([(50_000_000_000, 400_000_000_000, 7)], "c long, total long, v long")
    assert rows.select(divergence.level("c", "total").alias("p")).first()["p"] == 1 + 10**9 * 50_000_000_001 // 400_000_000_007


# ---------------------------------------------------------------- spelling


def brute_words(rows, min_length, erratum):
    found = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % erratum == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= min_length}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(ns, key=lambda o: (-words[o], o)) for w, ns in near.items() if ns}
    form = {w: o for w, o in best.items() if words[o] >= ratio * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize(("alphabet", "length", "hot_rows"), [("ab", 1, 10_000), ("abc", 2, 3), ("abcdé", 4, 10)])
def test_variants_against_all_pairs(spark, alphabet, length, hot_rows):
    rng = random.Random(length)
    words = {"".join(rng.choices(alphabet, k=rng.randint(length, length + 4))) for _ in range(300)} | {alphabet[0] * k for k in range(length, length + 5)}
    rows = [(i, f"{w} " * rng.choice([1, 2, 3, 20, 300, 5000])) for i, w in enumerate(sorted(words))] + [(None, None), (None, "aaaa Aaaa"), (3, ""), (3, "aab aab"), (3, "aab aab")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    for erratum in (31, 2):
        got = {tuple(r) for r in spelling.variants(docs, min_length=length, ratio=3, erratum=erratum, hot_rows=hot_rows).collect()}
        assert got == brute_variants(brute_words(rows, length, erratum), 3)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_a_word_moves_once_for_each_light_edge(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefgh", k=9)) for _ in range(3000)} | {"q" * k for k in range(1, 200)}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    most = spelling.light_edges(frame).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= len(words).bit_length()


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["letterabcde", "letterabcdf", "letterabcgf", "letterabhgf", "letterakhgf"]
    docs = spark.createDataFrame([(1, " ".join(" ".join([w] * 2 * 10**i) for i, w in enumerate(chain)))], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(docs, erratum=1 << 40).collect()}
    assert got == {w: (chain[i + 1] if i < 4 else None, chain[4]) for i, w in enumerate(chain)}

"""Decontamination, token counts and quality against brute force and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, quality, queries, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i : i + size]))
                if ids is not None:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in ids if x is not None}
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


def case():
    rng = random.Random(8)
    vocab = ["a", "B", "ç", "d1", "e", "F", "g", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 9, 10, 11, 25])))) for i in range(30)] + [(None, "null id words here"), (31, None), (2, "twice the same id"), (33, "twice the same id")]
    docs = [(i, " ".join(rng.choice(vocab + ["z"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    docs += [(100 + i, f"Start, {t.upper()}... end") for i, (_, t) in enumerate(items) if t] + [(None, None), (-1, ""), (-2, "null-id.words/here"), (-2, "null-id.words/here"), (-3, "q " * 50_000 + (items[3][1] or ""))]
    return docs, items


def test_hits_equal_brute_force_in_one_pass_and_many(spark):
    docs, items = case()
    frame = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id int, text string, hits string, items int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, n_words int")
    want = sorted(map(repr, brute(docs, items)))
    for most in (100_000, 40):
        got = [(r["row"]["doc_id"], r["n_words"], list(r["hits"]), list(r["items"])) for r in decontaminate.scan(frame, bench, most=most).collect()]
        assert sorted(map(repr, got)) == want
    assert decontaminate.clean(frame, bench).columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(frame, bench).collect()) == sorted(str(d) for d, _, h, _ in brute(docs, items) if not h)
    assert all(r["hits"] == [] for r in decontaminate.scan(frame, bench.limit(0)).collect()) and decontaminate.scan(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 10, 128])
def test_pieces_of_any_size_give_the_same_hits(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    docs, items = case()
    automaton = decontaminate.build([(None if i is None else str(i), t) for i, t in items])
    got = [(d, n, hits.tolist(), found) for (d, _), (n, hits, found) in zip(docs, automaton.scan([t for _, t in docs]), strict=True)]
    assert got == brute(docs, items)
    nested = decontaminate.build([("a", "x y z"), ("b", "y z"), ("c", "z"), ("d", "q x y")])
    assert [(h.tolist(), i) for _, h, i in nested.scan(["q x y z", "y", "w z", None, ""])] == [([0, 1, 2, 3], ["a", "b", "c", "d"]), ([], []), ([1], ["c"]), ([], []), ([], [])]
    assert [n for n, _, _ in decontaminate.build([]).scan(["a b", ""])] == [2, 0]


def test_a_word_with_the_hash_of_a_known_one_is_no_hit(monkeypatch):
    automaton = decontaminate.build([("a", "one two")])
    real = decontaminate.range_hashes

    def same(data, first, last):
        out = real(data, first, last)
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            if data[a:b].tobytes() == b"uno":
                out[i] = real(np.frombuffer(b"one", np.uint8), np.array([0]), np.array([3]))[0]
        return out

    monkeypatch.setattr(decontaminate, "range_hashes", same)
    assert [h.tolist() for _, h, _ in automaton.scan(["uno two", "one two", "uno one two"])] == [[], [0, 1], [1, 2]]


def test_spans_lead_back_to_the_original(spark):
    text = "Zü, ONE two-three x ONE Two"
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    bench = spark.createDataFrame([(5, "one two")], "item_id int, text string")
    spans = decontaminate.scan(frame, bench).select(decontaminate.byte_spans(F.col("row.text"), F.col("hits")).alias("s")).first()["s"]
    assert [text.encode()[s["start"] : s["stop"]].decode() for s in spans] == ["ONE two", "ONE Two"]


def test_query_digests(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: (n, len(h), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(h)) for d, n, h, f in brute(docs, items)}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries.op5_decontaminate(spark, sf).collect()}
    assert got == want and any(v[4] for v in got.values())


# ---------------------------------------------------------------- separators


def plain_counts(file, ids, sep):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == sep:
            out.append((file, len(out), start, i - start, True))
            start = i + 1
    return out + ([(file, len(out), start, len(ids) - start, False)] if start < len(ids) else [])


def counts_of(df, pattern=r"(\d+)\.bin"):
    return sorted((int(re.search(pattern, r["file"])[1]), r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in df.collect())


@pytest.mark.parametrize("width,sep", [(2, 3), (2, 0x0A0A), (2, 0xC450), (4, 50256), (4, 0x0A0A0A0A), (2, 0xBBEF)])
def test_flat_files_of_any_split_equal_a_plain_loop(spark, monkeypatch, tmp_path, width, sep):
    monkeypatch.setattr(token_counts, "GROUP", 300)
    real = token_counts._searcher

    def small(*args):
        run = real(*args)

        def search(batches):
            token_counts.PIECE = 5
            return run(batches)

        return search

    monkeypatch.setattr(token_counts, "_searcher", small)
    rng = np.random.default_rng(width + sep)
    pool = [sep, sep, 0x0A0A, 0x0A, 0x0A00, sep >> 8, sep & 255, 7, 0xEFBB, 0xBBEF, 0xBFBF, 0x0D0A]
    want = []
    for f in range(7):
        ids = [[], [sep], [sep] * 40, [7] * 50, [0xBBEF, 0xBF00 | (sep & 255), 5, sep]][f] if f < 5 else [pool[k] for k in rng.integers(0, len(pool), 900)]
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids, f"<u{width}").tobytes())
        want += plain_counts(f, ids, sep)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("64", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            pieces = token_counts.search(token_counts.read_flat(spark, str(tmp_path)), sep, width)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert counts_of(token_counts.count_tokens(pieces, sep, width)) == sorted(want), split


def test_a_file_without_newline_bytes_is_read_in_many_partitions(spark, tmp_path):
    ids = np.full(400_000, 7, "<u2")  # no byte 0x0A
    ids[[5, 100_000, 399_998]] = 3
    ids.tofile(tmp_path / "1.bin")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        flat = token_counts.read_flat(spark, str(tmp_path))
        assert flat.rdd.getNumPartitions() >= 16
        got = counts_of(token_counts.count_tokens(token_counts.search(flat, 3), 3))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(plain_counts(1, ids.tolist(), 3))


def test_chunks_in_memory_and_their_edges(spark):
    chunks = spark.createDataFrame([("1.bin", None, 0, b"\x01\x00\x03"), ("1.bin", None, 1, b"\x00\x03"), ("1.bin", None, 2, b"\x00\x05\x00"), ("2.bin", None, 0, None)], "file string, size long, place int, data binary").coalesce(1)
    got = counts_of(token_counts.count_tokens(token_counts.search(chunks, 3, lines=False), 3))
    assert got == [(1, 0, 0, 1, True), (1, 1, 2, 0, True), (1, 2, 3, 1, False)]
    assert token_counts.count_tokens(token_counts.search(chunks.limit(0), 3, lines=False), 3).count() == 0
    odd = spark.createDataFrame([("1.bin", None, 0, b"\x01")], "file string, size long, place int, data binary")
    with pytest.raises(Exception, match="whole number"):
        token_counts.count_tokens(token_counts.search(odd, 3, lines=False), 3).collect()


def test_counts_of_documents(spark, sf, tmp_path):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id AS string) AS doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), ("x", ""), ("x", ""), ("y", "word " * 70_000)], "doc_id string, text string")).selectExpr("*", "1 AS part", "2 AS ids").repartition(3)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    packed = token_counts.pack(docs, ranks, 50256)
    out = token_counts.count_by_document(packed, 50256).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(r["doc_id"]), len(coder.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    for part in {r["file"] for r in out}:
        own = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in out if r["file"] == part)
        assert [o for o, _, _ in own] == list(range(len(own))) and all(a[1] + a[2] + 1 == b[1] for a, b in zip(own, own[1:], strict=False))
    assert token_counts.count_by_document(token_counts.pack(docs.limit(0), ranks, 50256), 50256).count() == 0
    with pytest.raises(Exception, match="agree"):
        token_counts.count_by_document((packed[0], packed[1].where("ordinal <> 1")), 50256).collect()
    with pytest.raises(ValueError):
        token_counts.pack(docs, ranks, 50255)


def test_token_count_query_against_the_library(spark, sf):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted((r["doc_id"], r["n_tokens"]) for r in queries.op9_token_counts(spark, sf).collect())
    assert got == sorted((r["doc_id"], len(coder.encode_ordinary(r["text"] or ""))) for r in docs)


# ---------------------------------------------------------------- quality


def test_model_is_the_textbook_formula():
    rng = np.random.default_rng(2)
    d = 3
    x0, x1 = rng.normal(0, 1, (400, d)), rng.normal(1, 2, (300, d))
    sums, products = np.array([x.sum(0) for x in (x0, x1)]), np.array([x.T @ x for x in (x0, x1)])
    m = quality.model_of(np.array([400.0, 300.0]), sums, products)
    z = (np.array([0.3, -1, 2]) - m.centre) / m.scale
    density = []
    for c, x in enumerate((x0, x1)):
        own = (x - m.centre) / m.scale
        covs = [np.cov(((y - m.centre) / m.scale).T, bias=True) for y in (x0, x1)]
        cov = (1 - quality.POOL) * covs[c] + quality.POOL * (400 * covs[0] + 300 * covs[1]) / 700
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / d * np.eye(d)
        delta = z - own.mean(0)
        density.append(-0.5 * (delta @ np.linalg.solve(cov, delta) + np.linalg.slogdet(cov)[1]))
    got = [-0.5 * (np.square(w @ (z - mean)).sum() + det) for mean, w, det in zip(m.means, m.whiteners, m.log_dets, strict=True)]
    assert np.allclose(got, density, atol=1e-3)


def plain_statistics(text):
    """One text, by plain loops."""
    data = (text or "").encode()
    w = data.split()
    n, size = len(w), max(len(data), 1)
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    count = lambda test: sum(map(test, data))
    upper, small, digit, high = count(lambda b: 65 <= b < 91), count(lambda b: 97 <= b < 123), count(lambda b: 48 <= b < 58), count(lambda b: b >= 128)
    stops, blanks, newlines = count(lambda b: b in b".,;:?'-()\""), count(lambda b: b in b" \t\x0b\f\r"), count(lambda b: b == 10)
    other = len(data) - upper - small - digit - high - stops - blanks - newlines
    mean = sum(map(len, w)) / n if n else 0
    spread = math.sqrt(sum((len(x) - mean) ** 2 for x in w) / n) if n else 0
    pairs = list(zip(w, w[1:]))
    lines = data.split(b"\n")
    shares = [c / size for c in collections.Counter(data).values()]
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), odds(upper, upper + small + high), odds(small, size), odds(digit, size), odds(high, size), odds(stops, size), odds(other, size), odds(blanks, size), odds(newlines, size),
        odds(len(set(w)), n), odds(len(set(pairs)), len(pairs)), odds(max(collections.Counter(w).values(), default=0), n), odds(sum(a == b for a, b in pairs), len(pairs)), -sum(p * math.log(p) for p in shares),
        odds(sum(not (x[-1] >= 0x61 or x[-1] in b".,;:?") for x in w), n), odds(len(set(lines)), len(lines)), math.log1p(len(data) / len(lines)), float(n == 0),
    ]


def test_statistics_equal_plain_loops(spark, sf, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "A a A a", "é è\té", "x" * 9_000 + " " + "x" * 9_000 + "\n" + "x" * 9_000, "same line\n" * 700, "".join(rng.choice("ab \n.") for _ in range(5_000)), "\x1c \x85 \u3000 w"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(quality.statistics_of(texts), want, atol=1e-9) and quality.statistics_of([]).shape == (0, len(quality.NAMES))
    monkeypatch.setattr(quality, "_SPAN", 700)
    assert np.allclose(quality.statistics_of(texts), want, atol=1e-9)


def test_query_scores_equal_the_textbook_formula(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    learnt = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in docs and r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    stats = {d: np.array(plain_statistics(t)) for d, t in docs.items()}
    x, y = np.array([stats[d] for d, _ in learnt]), np.array([q for _, q in learnt])
    centre, scale = x.mean(0), np.where(x.var(0) > 1e-12, x.std(0), 1)
    z, d = (x - centre) / scale, x.shape[1]
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * covs[c] for c in (0, 1)) / len(y)
    shrunk = [(1 - quality.POOL) * c + quality.POOL * pooled for c in covs]
    shrunk = [(1 - quality.RIDGE) * c + quality.RIDGE * (np.trace(c) / d + 1e-6) * np.eye(d) for c in shrunk]
    means = [z[y == c].mean(0) for c in (0, 1)]

    def score(own):
        t = (own - centre) / scale
        density = [-0.5 * ((t - m) @ np.linalg.solve(c, t - m) + np.linalg.slogdet(c)[1]) for m, c in zip(means, shrunk, strict=True)]
        n = math.expm1(own[0])
        return 1 / (1 + math.exp(-(quality.TEMPER * n / (n + quality.FEW) * (density[1] - density[0]) + math.log((y == 1).sum() / (y == 0).sum()))))

    got = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert abs(r["score"] - score(stats[i])) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_repeated_labels_and_labels_without_documents(spark):
    docs = spark.createDataFrame([(1, "one two three."), (2, "@@ ## $$"), (3, "four five six."), (4, "%% && !!"), (None, "x")], "doc_id long, text string")
    labels = [(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (99, 1), (None, 1), (2, None), (3, 7)]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.rows.tolist() == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (2, 4)), sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 1, 3))]
    assert quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), most=2).rows.sum() <= 2


def test_held_out_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if d in scores and scores[d]["held_out"]]
    assert all(scores[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in scores) and len(held) > 40
    assert np.mean([scores[d]["predicted"] == labels[d] for d in held]) > 0.95
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "\n \n", 3), (3, "x" * 500_000, 4)], "doc_id long, text string, _score int")
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = odd.select(quality.scorer(model)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got) and got[0]["s"] == got[1]["s"]
    assert quality.keep_good(odd, model).columns == odd.columns
    empty = quality.fit(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["s"] for r in odd.select(quality.scorer(empty)("text").alias("s")).collect()} == {0.5}
    single = quality.fit(odd, spark.createDataFrame([(2, 1), (3, 1), (9, 0)], "doc_id long, quality int"))
    assert {r["s"] for r in odd.select(quality.scorer(single)("text").alias("s")).collect()} == {1.0}

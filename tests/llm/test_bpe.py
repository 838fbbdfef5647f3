"""Pre-tokens and ids against tiktoken, storage round trips, and decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarry.llm import bpe, queries
from quarry.llm.common import materialise

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


PIECES = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", "é", "1", "२", "!", "?", " ", "　", "A", "x", "\x1c", "\x85", "᠎", "한", "😀", "́", "'S", " ", "\U0010ffff", "\x00"]


def test_pretokens_give_the_ids_of_the_whole(coder):
    rng = random.Random(4)
    for _ in range(3000):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        data, offsets, counts = bpe.pretokens(texts)
        k = 0
        for text, count in zip(texts, counts, strict=True):
            pieces = [data[offsets[i] : offsets[i + 1]] for i in range(k, k + count)]
            k += count
            assert b"".join(pieces) == text.encode()
            assert [t for p in pieces for t in coder._encode_single_piece(p)] == coder.encode_ordinary(text), repr(text)


def test_long_texts_are_cut_where_a_pretoken_starts(coder):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice([*PIECES, "word", " a", " 1", "x y"]) for _ in range(rng.randint(0, 120)))
        parts = list(bpe.parts_of(text, 20))
        assert "".join(parts) == text and [t for p in parts for t in coder.encode_ordinary(p)] == coder.encode_ordinary(text)
    assert max(map(len, bpe.parts_of("some words " * 1_000, 100))) < 120


def test_storage_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 31, 32, 33, 1000):
        codes = np.unique(rng.integers(0, max(1, n // 2), n), return_inverse=True)[1]
        place = rng.permutation(codes.max(initial=-1) + 1)
        assert (bpe.read_positions(bpe.code_positions(codes, place)) == place[codes]).all()
    words = sorted({bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8)) for _ in range(500)} | {b"a" * 300, b"a" * 400, b"a" * 401})
    assert bpe.front_decode(bpe.front_code(words)) == words and bpe.front_decode(bpe.front_code([])) == []


def test_merges_equal_the_library(coder):
    rng = random.Random(11)
    merge = bpe.Merger(bpe.read_ranks(PATH))
    words = [p.encode() for p in PIECES] + [bytes(rng.randrange(256) for _ in range(rng.randint(1, 90))) for _ in range(3_000)]
    words += ["".join(rng.choice("aeioutnrsldé") for _ in range(rng.randint(1, 70))).encode() for _ in range(5_000)]
    words += [b" " * 3_000, "é".encode() * 20_000, b"ab" * 31 + b"c", b"a" * 64, b"a" * 65]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in merge.encode(words)] == [coder._encode_single_piece(w) for w in words]
    assert merge.encode([]) == []
    with pytest.raises(ValueError):
        bpe.Merger({b"a": 0})


@pytest.mark.parametrize("block,bucket,cache", [(1 << 22, 400_000, 1 << 20), (3_000, 500, 1 << 20), (3_000, 500, 100)])
def test_encoding_whole_texts(spark, sf, coder, monkeypatch, block, bucket, cache):
    monkeypatch.setattr(bpe, "BUCKET_WORDS", bucket)
    real, encoder, every = bpe._to_blocks, bpe._encoder, 4

    def small(batches):
        bpe.BLOCK_BYTES, bpe.SEGMENT_BYTES, bpe.PIECE_BYTES, bpe.EVERY = block, max(block // 2, 1), min(block, 1 << 20), every
        return real(batches)

    def forgetful(ranks):
        encode = encoder(ranks)

        def run(batches):
            bpe.CACHE_WORDS = cache
            return encode(batches)

        return run

    monkeypatch.setattr(bpe, "_to_blocks", small)
    monkeypatch.setattr(bpe, "_encoder", forgetful)
    monkeypatch.setattr(bpe, "EVERY", every)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-2, "it's 's  x", None), (-2, "it's 's  x", None), (-3, "é" * 30_000, "x"), (-4, " " * 5_000 + "\n", "x"), (-5, "long text of words. " * 2_000, "x")], "doc_id long, text string, lang string")
    rows = docs.unionByName(odd)
    want = sorted((str(r["doc_id"]), str(r["lang"]), np.array(coder.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in rows.collect())
    coded = materialise(bpe.encode(rows, PATH, ["doc_id", "lang"]), "coded")
    got = coded.collect()
    assert sorted((str(r["row"]["doc_id"]), str(r["row"]["lang"]), bytes(r["ids"])) for r in got) == want and all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    back = sorted(bytes(r[0]) for r in coded.select(bpe.decoder(spark, PATH)("ids")).collect())
    assert back == sorted((r["text"] or "").encode() for r in rows.collect())


def test_query_against_the_library(spark, sf, coder):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = {d: (len(ids := coder.encode_ordinary(t)), digest(np.array(ids, "<u4").tobytes()), digest(t.encode())) for d, t in docs.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_bpe(spark, sf).collect()} == want


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "doc_id long, text string, ids int, n_tokens int")
    assert bpe.encode(none, PATH, ["doc_id"]).count() == 0
    bad = spark.createDataFrame([(b"\xff\xff\xff\xff",)], "ids binary")
    with pytest.raises(Exception, match="vocabulary"):
        bad.select(bpe.decoder(spark, PATH)("ids")).collect()
    assert spark.createDataFrame([(None,)], "ids binary").select(bpe.decoder(spark, PATH)("ids").alias("b")).first()["b"] is None

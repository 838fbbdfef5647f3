"""The corpus pipeline stage by stage against brute force, and its edges."""

import collections

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from quarry.llm import bpe, quality
from quarry.llm.common import materialise
from tests.llm.test_native import brute_lines
from tests.llm.test_ngram_join import brute as brute_pairs
from tests.llm.test_scans import brute as brute_hits


def test_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    given, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (given.collect(), (out := materialise(stage(spark, given, sf), name)).collect())
        if name != "bpe":
            assert out.columns == docs.columns
        given = out
    before, after = seen["quality"]
    model = quality.fit(docs, labels)
    scores = model.score(quality.statistics_of([r["text"] for r in before]))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= 0.3} and len(after) < len(before)
    before, after = seen["line_dedup"]
    lines = brute_lines([(r["doc_id"], r["text"]) for r in before], 10, False)
    assert {(r["doc_id"], r["text"]) for r in after} == {(d, kept) for (d, _), (_, _, kept) in lines.items()} and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["near_duplicates"]
    groups = brute_pairs([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {g for _, g, _ in groups} and len(after) < len(before)
    before, after = seen["decontaminate"]
    assert {r["doc_id"] for r in after} == {d for d, _, hit, _ in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if not hit}
    before, after = seen["bpe"]
    path = public_tokenizers.path(corpus_pipeline.TOKENIZER)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {r["doc_id"]: np.array(coder.encode_ordinary(r["text"]), "<u4").tobytes() for r in before}
    assert {r["doc_id"]: bytes(r["ids"]) for r in after} == want
    whole = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in whole) == collections.Counter((r["doc_id"], r["n_tokens"]) for r in after)


def test_odd_rows_go_through_every_stage(spark, sf):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "A fine and long day by the sea, with friends.", "en", "s", 44, 2)], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    for rows in (odd, odd.limit(0)):
        given = rows
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, given, sf), name)
            if name != "bpe":
                assert out.columns == odd.columns, name
            given = out
        assert given.count() <= rows.count()

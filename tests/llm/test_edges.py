"""Every operator and stage on rows whose extra columns have the names that operators use inside or in their results, on nulls, repeats and empty tables."""

import pathlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, decontaminate, divergence, exact_dedup, licences, line_dedup, media, ngram_join, quality, sharding, spelling, token_counts, url_filter

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def names():
    """All words that stand in quotes in the subpackage and could be columns."""
    found = set()
    for path in pathlib.Path(bpe.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'"([a-z_][a-z_0-9]*)"', path.read_text()))
    return sorted(n for n in found if n not in ("doc_id", "text", "url", "page_id"))


def rows(spark, count=12):
    line = "a line that many documents share with each other\n"
    given = [(None, None), (1, ""), (1, ""), (2, line + "one"), (2, line + "one"), (3, "Released under the MIT License.\n" + line)] + [(10 + i, line + f"own words number {i} of this text\nand more of it " * (i + 1)) for i in range(count)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    return frame.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names())], F.lit("x").alias("dotted.name"), F.lit("y").alias("Upper Case"))


def bench(spark):
    return spark.createDataFrame([(1, "own words number 3 of this text and more of it")], "item_id int, text string").withColumns({"hits": F.lit(1), "row": F.lit(2)})


def model(spark):
    return quality.fit(rows(spark), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))


OPERATORS = {
    "flac": lambda spark, d: media.pcm_blocks(d.withColumn("m", media.to_flac(media.padded(F.col("text")))), "m"),
    "urls": lambda spark, d: url_filter.judge(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), url_filter.rules_frame(spark, [("block", "com", "/x")])),
    "bpe": lambda spark, d: bpe.encode(d, PATH, [c for c in d.columns if c not in ("text", "dotted.name")], decoded=True),
    "join": lambda spark, d: ngram_join.similar(d),
    "keep": lambda spark, d: ngram_join.keep_one(d),
    "decontaminate": lambda spark, d: decontaminate.scan(d, bench(spark)),
    "clean": lambda spark, d: decontaminate.clean(d, bench(spark)),
    "licences": lambda spark, d: licences.scan(d, licences.train(licences.background_of(d))),
    "lines": lambda spark, d: line_dedup.dedup_lines(d),
    "first lines": lambda spark, d: line_dedup.dedup_lines(d, keep_first=True),
    "shards": lambda spark, d: sharding.shard_records(d, [1.0, 2.0], 1.0),
    "tokens": lambda spark, d: token_counts.count_by_document(token_counts.pack(d, bpe.read_ranks(PATH), 50256), 50256),
    "quality": lambda spark, d: quality.keep_good(d, model(spark), 0.0),
    "copies": lambda spark, d: exact_dedup.dedup(d),
    "first copies": lambda spark, d: exact_dedup.keep_first(d),
    "divergence": lambda spark, d: divergence.audit(d.withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})),
    "spelling": lambda spark, d: spelling.variants(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_with_clashing_names(spark, tmp_path, name):
    rows(spark).write.parquet(f"{tmp_path}/d")
    given = spark.read.parquet(f"{tmp_path}/d")
    out = OPERATORS[name](spark, given)
    n = out.count()
    if name in ("decontaminate", "licences", "lines", "first lines", "copies"):
        assert out.select("row.*").columns == given.columns
    if name in ("keep", "clean", "quality", "first copies"):
        assert out.columns == given.columns and 0 < n <= given.count()
    elif name not in ("flac", "divergence", "spelling"):
        assert n == given.count()
    assert OPERATORS[name](spark, given.limit(0)).count() == 0


def test_stages_with_clashing_names(spark, sf, tmp_path):
    given = rows(spark)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (given, given.limit(0)):
            out = stage(spark, docs, sf)
            out.write.mode("overwrite").parquet(f"{tmp_path}/{i}")
            if name != "bpe":
                assert out.columns == given.columns, name
        stage(spark, given, sf).write.mode("overwrite").parquet(f"{tmp_path}/{i}")
        given = spark.read.parquet(f"{tmp_path}/{i}")
        assert given.columns[0] == "doc_id"

"""From raw documents to token ids, in five stages; each works on all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. line_dedup: lines found in at least 10 documents go from every text.
3. near_duplicates: of each group of linked documents the one with the smallest id stays.
4. decontaminate: documents that hold a benchmark window go.
5. bpe: texts become ids, which are decoded again as a check.

All stages but the last return the columns they were given.

Defined cases: a null text is an empty one to every stage; it keeps its null until
line_dedup, which gives texts without repeated lines back as they are and null as
empty.  A null id is an id like others and is never matched with a label.  Repeated
rows are documents of their own for quality, line_dedup (each counts) and bpe; of
rows with equal id and text near_duplicates keeps the first by all columns.  Other
columns may have any name; n_chars, where there is one, follows a text that lost
lines.  An empty table goes through all stages empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from quarry.llm.common import materialise, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
MIN_QUALITY, MIN_LINE_DOCS = 0.3, 10


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), MIN_QUALITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, row = line_dedup.dedup_lines(docs, MIN_LINE_DOCS), F.col("row")
    if "n_chars" in docs.columns:
        row = F.when(F.col("n_dropped") > 0, row.withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType))).otherwise(row)
    return kept.select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, row (all other columns but the text), n_tokens, ids and decoded_sha256."""
    kept = [c for c in docs.columns if c != "text"]
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), kept, decoded=True)
    return coded.select(F.col("row.doc_id").alias("doc_id"), "row", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

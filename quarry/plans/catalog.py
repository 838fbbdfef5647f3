"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans import controls, evidence, formats, inspections, more_evidence, pages, protocols, readers, runs, scale, wrappings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def integrity_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against actual length of every document, folded to counts by source."""
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("text").isNull(), "NOT_RUN").when(F.length("text") == F.col("n_chars"), "PASS").otherwise("FAIL")
    return docs.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"integrity_by_source": integrity_by_source, **controls.QUERIES, **evidence.QUERIES, **formats.QUERIES, **inspections.QUERIES, **more_evidence.QUERIES, **pages.QUERIES, **protocols.QUERIES, **readers.QUERIES, **runs.QUERIES, **scale.QUERIES, **wrappings.QUERIES}

ORACLE: dict[str, str] = {
    "integrity_by_source": """
SELECT source, CASE WHEN text IS NULL THEN 'NOT_RUN' WHEN length(text) = n_chars THEN 'PASS' ELSE 'FAIL' END AS status,
       count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars
FROM documents GROUP BY ALL""",
    **controls.ORACLE,
    **evidence.ORACLE,
    **formats.ORACLE,
    **inspections.ORACLE,
    **more_evidence.ORACLE,
    **pages.ORACLE,
    **protocols.ORACLE,
    **readers.ORACLE,
    **runs.ORACLE,
    **scale.ORACLE,
    **wrappings.ORACLE,
}

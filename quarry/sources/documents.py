"""Metadata documents and line protocols as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_document(spark: SparkSession, path: str, schema: str | T.StructType, most: int = 32 << 20) -> DataFrame:
    """source, raw, sha256, document and fault of whole JSON files; document is null where the text is no strict JSON (a repeated key is not: NOT_JSON) and where the file has more than ``most`` bytes (TOO_LARGE; its content is not read)."""
    found = spark.read.format("binaryFile").load(path)
    whole = found.where(F.col("length") <= most).select(F.col("path").alias("source"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw"), F.sha2("content", 256).alias("sha256"))
    read = whole.withColumn("document", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", schema, {"mode": "PERMISSIVE"})))
    read = read.withColumn("fault", F.when(F.col("document").isNull(), "NOT_JSON"))
    none = [F.lit(None).cast(read.schema[c].dataType).alias(c) for c in ("raw", "sha256", "document")]
    return read.unionByName(found.where(F.col("length") > most).select(F.col("path").alias("source"), *none, F.lit("TOO_LARGE").alias("fault")))


def exploded(documents: DataFrame, path: str) -> DataFrame:
    """A row for each element of an array inside ``document``, with its ordinal."""
    return documents.select("source", F.posexplode(F.col(f"document.{path}")).alias("ordinal", "row")).select("source", "ordinal", "row.*")


def pinned(documents: DataFrame, pins: DataFrame) -> DataFrame:
    """With status: PASS if the document's hash is the one that ``pins`` (source, sha256) has, FAIL if another, NOT_RUN if none."""
    want = pins.select(F.col("source"), F.col("sha256").alias("_pin"))
    return documents.join(want, "source", "left").withColumn("status", F.when(F.col("_pin").isNull(), "NOT_RUN").when(F.col("_pin") == F.col("sha256"), "PASS").otherwise("FAIL")).drop("_pin")


def strict_json(text: Column) -> Column:
    """A VARIANT, or null for text that is no JSON, repeats a key or has a fraction or an exponent."""
    value = F.try_parse_json(text)
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    return F.when(~bare.rlike(r"[0-9][.eE]"), value)


# An outline line: tabs for depth, a JSON string, and a destination.
_OUTLINE = r'^[|+-](\t*)("(?:[^"\\]|\\.)*")\t(.*)$'


def outline_lines(text: Column) -> Column:
    """Array of struct(ordinal, depth, title, page, destination) of an outline listing's lines; null title for a line of another form."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    page = lambda d: F.regexp_extract(d, r"(?:^#|&)page=([0-9]+)(?:&|$)", 1)

    def one(line: Column, i: Column) -> Column:
        destination = F.regexp_extract(line, _OUTLINE, 3)
        return F.struct(
            i.alias("ordinal"), F.length(F.regexp_extract(line, _OUTLINE, 1)).alias("depth"), F.try_variant_get(F.try_parse_json(F.nullif(F.regexp_extract(line, _OUTLINE, 2), F.lit(""))), "$", "string").alias("title"),
            F.nullif(page(destination), F.lit("")).try_cast("int").alias("page"), destination.alias("destination"),
        )

    return F.transform(lines, one)


def read_trace(spark: SparkSession, path: str, schema: str, marker: str = "LIMIT_EVENTS") -> tuple[DataFrame, DataFrame]:
    """(events, markers): typed rows of a tab-separated log, and its bare marker lines by file."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    parts = F.split("value", "\t", -1)
    events = lines.where(F.col("value") != marker).withColumn("p", parts)
    typed = [F.when(F.size("p") == len(fields), F.get("p", F.lit(i)).try_cast(f.dataType)).alias(f.name) for i, f in enumerate(fields)]
    whole = F.size("p") == len(fields)
    return events.select("source", *typed, whole.alias("well_formed")), lines.where(F.col("value") == marker).groupBy("source").agg(F.count(F.lit(1)).alias("markers"))


def tagged_lines(lines: DataFrame, by: list[str], text: str = "value") -> DataFrame:
    """by, tag and fields of lines whose first word is their kind."""
    return lines.select(*by, F.substring_index(text, " ", 1).alias("tag"), F.slice(F.split(text, " "), 2, 1 << 20).alias("fields"))

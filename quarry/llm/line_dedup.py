"""Line deduplication [native]: hashes dealt by range, first occurrences streamed in (document, position) order, keep bitmaps returned instead of text.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both
ends and with A-Z in lower case; its hash is the key's MD5.  Empty keys are
never dropped.  Every row of the input is a document.

1. One pass splits the texts and writes (hash, document, position) of all lines.
2. These are dealt by range of (hash, salt) and sorted by hash, document and
   position.  The salt, of 20 bits, is drawn from the document: ranges can cut
   one line anywhere, so a line in a third of all documents fills a third of the
   ranges, while a rarer line's salts are neighbours in one range.  A stream over
   the sorted rows counts, for each line, the rows that are first in their
   document, and takes the first of all; sums over salts follow, which the ranges
   have combined already.
3. Lines meet their counts: those of at least ``HOT_ROWS`` rows, and more than one
   in ``HOT_KEYS`` of all, are at most ``HOT_KEYS`` and are broadcast; all others
   are too rare to be skewed and are joined by shuffle.
4. A document's dropped positions become runs.

A document's bitmap is run-length coded: ``drop_runs`` holds the first and last
position of each run of dropped lines; all other lines are kept.

Defined cases: null and empty text are one empty line; rows with equal id and
equal text are documents of their own and get equal results (with ``keep_first``,
the first occurrence stays in each of them); a null id is an id like others;
other columns, of any name, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"
#: Parts that ranges can cut the rows of one line into.
SALTS = 1 << 20
#: A line is hot from so many rows on, and from the share of all rows that leaves so many hot lines at most.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """row, with all columns, _text, and _hash: it tells apart texts under one id."""
    filled = F.coalesce(F.col("row")[text], F.lit(""))
    return docs.select(F.struct("*").alias("row")).select("row", filled.alias("_text"), F.xxhash64(filled).alias("_hash"))


def line_hashes(text: Column) -> Column:
    """For each line its key's MD5, or null for an empty key."""
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(F.transform(trimmed, lower_ascii), lambda key: F.when(key != "", F.unhex(F.md5(key.cast("binary")))))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """line_hash, _doc, _hash (of the text) and _pos of every line with a key, written once to the shared folder."""
    rows = _identified(docs, text).select(F.col("row")[doc_id].alias("_doc"), "_hash", F.posexplode(line_hashes(F.col("_text"))).alias("_pos", "line_hash"))
    return materialise(rows.where(F.col("line_hash").isNotNull()), "lines")


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """line_hash, n_docs, n_rows and first (struct of _doc, _hash, _pos) of every key that at least ``min_docs`` documents hold; ``lines``: of ``lines_of``."""
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_doc", "_hash"), F.lit(SALTS)).cast("int"))
    dealt = salted.repartitionByRange("line_hash", "_salt")
    of_document = Window.partitionBy("line_hash", "_salt", "_doc", "_hash").orderBy("_pos")
    streamed = dealt.select("line_hash", "_doc", "_hash", "_pos", F.first("_pos").over(of_document).alias("_first"))
    found = streamed.groupBy("line_hash").agg(
        F.count_if(F.col("_pos") == F.col("_first")).alias("n_docs"),  # equal rows have equal first positions, and each counts
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.struct("_doc", "_hash", "_pos")).alias("first"),
    )
    return found.where(F.col("n_docs") >= min_docs)


def _meet(lines: DataFrame, frequent: DataFrame, columns: list[str], hot_rows: int) -> DataFrame:
    """The rows of ``lines`` that are frequent, with ``columns`` of ``frequent``."""
    least = max(hot_rows, lines.count() // HOT_KEYS)
    hot = F.broadcast(frequent.where(F.col("n_rows") >= least).select(columns))
    cold = frequent.where(F.col("n_rows") < least).select(columns)
    return lines.join(hot, "line_hash").unionByName(lines.join(hot, "line_hash", "left_anti").join(cold, "line_hash"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """_doc, _hash, drop_runs array<struct<first, last>> and n_dropped, for documents that lose lines.

    ``keep_first``: a repeated key's first occurrence stays, else none does.
    """
    lines = lines_of(docs, doc_id, text)
    hit = _meet(lines, materialise(frequent_lines(lines, min_docs), "frequent"), ["line_hash", "first"] if keep_first else ["line_hash"], hot_rows)
    if keep_first:
        hit = hit.where(~F.col("first").eqNullSafe(F.struct("_doc", "_hash", "_pos")))
    at = hit.groupBy("_doc", "_hash").agg(F.array_sort(F.collect_set("_pos")).alias("at"))
    starts = F.filter("at", lambda p, j: (j == 0) | (F.col("at")[F.greatest(j - 1, F.lit(0))] != p - 1))
    ends = F.filter("at", lambda p, j: (j == F.size("at") - 1) | (F.col("at")[F.least(j + 1, F.size("at") - 1)] != p + 1))
    return at.select("_doc", "_hash", F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("drop_runs"), F.size("at").cast("long").alias("n_dropped"))


def dropped_positions(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """row (all columns of ``docs``, with the kept text in ``text``), n_lines, n_dropped and drop_runs."""
    bitmaps = drop_bitmaps(docs, min_docs, keep_first, doc_id, text, hot_rows).withColumnsRenamed({"_doc": "_bit_doc", "_hash": "_bit_hash"})
    rows = _identified(docs, text)
    joined = rows.join(bitmaps, F.col("row")[doc_id].eqNullSafe(F.col("_bit_doc")) & (F.col("_hash") == F.col("_bit_hash")), "left")
    cut = joined.select("row", "_text", F.split("_text", "\n").alias("_split"), "drop_runs", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), dropped_positions(F.col("drop_runs")))
    out = F.when(F.col("drop_runs").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("_split")[i]), "\n"))
    return cut.select(F.col("row").withField(f"`{text}`", out).alias("row"), F.size("_split").cast("long").alias("n_lines"), "n_dropped", "drop_runs")

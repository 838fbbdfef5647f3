"""Source divergence audit: an inverted index of terms whose postings correct a baseline of zero counts.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z in lower case.  A
language keeps the V terms of at least ``MIN_DOCS`` of its documents.  Each group (a
source in a language) and each language gives a kept term the level
p = 1 + floor(10^9 (count + 1) / (N + V)), N being the sum of its counts of kept
terms; f(p, q) = floor((p - q)^2 / q).  The divergence of a group from another source
of the language is the sum of f over the kept terms.

1. Each split of the texts is folded to (language, source, term) with occurrences and
   documents; Spark adds these up, first by all three, then to one posting list a term,
   written to the shared folder.  A list has at most an entry for each source.
2. Each pair of sources starts at V f(p0, q0), the levels of zero counts.  Most terms
   have few sources, and only postings correct the start:
   - a posting moves its own side: f(p, q0) - f(p0, q0).  This depends on the count
     alone, so postings are folded to (source, count) before they meet the other sources;
   - two postings of one term add f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), folded to
     (source, count, source, count) before f is taken; corrections of zero are left out.
   The sum is the exact one: floors are taken in every f, and integers are added.
3. A group's terms above the language's level are ranked by a window whose limit runs
   before the shuffle, so that no task sees more than the limit of each split.

Products are decimals of 38 digits where a count stands in them; levels are at most
10^9 + 1, so the square of a difference fits in 64 bits, and so does every sum of f.

Defined cases: null text, language and source are empty ones; every row is a document;
a group without terms has pairs like others; V = 0 gives pairs of value 0 and no terms;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, pieces, release

MIN_DOCS, TOP_TERMS = 3, 200
#: Bytes of text whose counts a task holds.
HELD_BYTES = 48 << 20
#: A-Z in lower case; what is no letter and ASCII is a blank.
_TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in pieces(batches, "text"):
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            terms = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            occurrences.update(terms)
            documents.update(set(terms))
        size += texts.nbytes
        if size >= HELD_BYTES:
            yield from _rows(held)
            held, size = {}, 0
    yield from _rows(held)
    held.clear()
    release()


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        terms = list(occurrences)
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            columns = [
                pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).view(pa.string()),
                pa.array([occurrences[t] for t in part], pa.int64()), pa.array([documents[t] for t in part], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _filled(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(as_) for c, as_ in zip(columns, ("lang", "source", "text"), strict=False)])


def posting_lists(docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, term, total and posts (array of source, n) of every kept term, written to the shared folder."""
    bound_batches(docs.sparkSession)
    split = _filled(docs, lang, source, text).mapInArrow(_count_terms, _COUNTED)
    cells = split.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = cells.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return materialise(lists.where(F.col("docs") >= min_docs).drop("docs"), "postings")


def level(count: str, total: str, kept: str = "v") -> Column:
    return F.expr(f"1 + (1000000000BD * cast({count} + 1 AS decimal(20, 0))) div cast({total} + {kept} AS decimal(20, 0))")


def gap(p: str, q: str) -> str:
    """SQL of f(p, q)."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def groups_of(docs: DataFrame, lists: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, of the group n_own (N), of its language v (V) and n_lang (N), and zero, the level of a count of zero, null where V is 0."""
    of_lang = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    of_group = lists.select("lang", F.explode("posts").alias("post")).groupBy("lang", "post.source").agg(F.sum("post.n").alias("n_own"))
    found = _filled(docs, lang, source).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n_own", "v", "n_lang"])
    return materialise(found.withColumn("zero", F.when(F.col("v") > 0, level("0", "n_own"))), "groups")


def _side(groups: DataFrame, name: str) -> DataFrame:
    return groups.select("lang", F.col("source").alias(name), F.col("n_own").alias(f"n_{name}"), F.col("zero").alias(f"zero_{name}"))


def _both_ways(found: DataFrame, there: str, back: str) -> DataFrame:
    """(lang, source, item, value) of a pair a, b in both directions, without zeros."""
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.expr(there).alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.expr(back).alias("value")))
    return found.select("lang", F.explode(ways).alias("w")).select("lang", "w.*").where("value <> 0")


def pair_values(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value."""
    others = _side(groups, "b")
    start = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("zero_a")).join(others, "lang").where("a <> b")
    baseline = start.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, F.expr(f"v * ({gap('zero_a', 'zero_b')})")).otherwise(F.lit(0)).alias("value"))

    postings = lists.select("lang", F.explode("posts").alias("post"))
    by_count = postings.groupBy("lang", F.col("post.source").alias("a"), F.col("post.n").alias("n")).agg(F.count(F.lit(1)).alias("terms"))
    levels = by_count.join(groups.select("lang", F.col("source").alias("a"), "n_own", "v", F.col("zero").alias("zero_a")), ["lang", "a"]).withColumn("p", level("n", "n_own"))
    one = _both_ways(
        levels.join(others, "lang").where("a <> b"),
        f"terms * ({gap('p', 'zero_b')} - {gap('zero_a', 'zero_b')})",
        f"terms * ({gap('zero_b', 'p')} - {gap('zero_b', 'zero_a')})",
    )

    firsts = lists.select("lang", "posts", F.explode("posts").alias("x"))
    pairs = firsts.select("lang", "x", F.explode("posts").alias("y")).where("x.source < y.source")
    folded = pairs.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("x"), F.col("y.n").alias("y")).agg(F.count(F.lit(1)).alias("terms"))
    both = folded.join(_side(groups, "a").join(groups.select("lang", "v").distinct(), "lang"), ["lang", "a"]).join(others, ["lang", "b"]).withColumns({"p": level("x", "n_a"), "q": level("y", "n_b")})
    two = _both_ways(
        both,
        f"terms * ({gap('p', 'q')} - {gap('p', 'zero_b')} - {gap('zero_a', 'q')} + {gap('zero_a', 'zero_b')})",
        f"terms * ({gap('q', 'p')} - {gap('q', 'zero_a')} - {gap('zero_b', 'p')} + {gap('zero_b', 'zero_a')})",
    )
    parts = [x.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20, 0)")).alias("value")) for x in (one, two)]
    every = baseline.withColumn("value", F.col("value").cast("decimal(30, 0)")).unionByName(parts[0]).unionByName(parts[1])
    return every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the group has and holds above its language's level) and value."""
    postings = lists.select("lang", "term", "total", F.explode("posts").alias("post")).select("lang", "term", "total", "post.source", "post.n")
    levels = postings.join(groups, ["lang", "source"]).withColumns({"p": level("n", "n_own"), "q": level("total", "n_lang")})
    return levels.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    lists = posting_lists(docs, min_docs, lang, source, text)
    groups = groups_of(docs, lists, lang, source)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda values, part: values.withColumns({"rank": F.row_number().over(order), "part": F.lit(part)})
    found = ranked(pair_values(lists, groups), "pair").unionByName(ranked(term_values(lists, groups), "term").where(F.col("rank") <= top_terms))
    return found.select("lang", "source", "part", "item", "value", "rank")

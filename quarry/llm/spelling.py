"""Spelling variant grouping by merging an errata trie along its heavy paths.

Words one edit apart part at one node of the trie of all words: the longest prefix p
that both have.  One goes on with the character a, the other with b or ends.  At every
node the heaviest child, c, continues the heavy path; the others are light, and so is
the end of a word at the node.  Only words in light subtrees are merged into what is
larger, so a word moves once for each light edge above it, at most log2 of the number
of words.  A word p b y in a light subtree gives

- with b replaced: p c y, on the heavy path;
- with b skipped: p y, unless y begins with b (then the words part further down);
- with the heavy character put in before b: p c b y, the heavy word with c skipped;
- p * y: the light subtrees of the node merged with their first character replaced.

Terminals that coincide are words one edit apart, and each such pair coincides once:
with another word in the first three cases, among at most an alphabet of light words
in the last.  All is done by Spark on rows (prefix, branch): nodes are counts by
prefix, heavy children a maximum, merges joins and grouping by the spelled-out path.
Nodes near the root, which a large share of all words passes, are broadcast: those of
at least ``HOT_ROWS`` words, and so many that at most ``HOT_NODES`` are.

A word's form is its near word with the largest count, if that is ``RATIO`` times its
own; forms are followed by pointer jumping, whose rounds are the logarithm of a chain's
length, and that is itself at most the logarithm of the largest count.

Defined cases: null text has no words; repeated rows are documents of their own; a null
id is an empty one; of near words with equal counts the first in code-point order is
taken; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialise

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a character.
ERRATUM = 31
HOT_ROWS, HOT_NODES = 10_000, 100_000
#: Stands for any character; no letter.
ANY = "*"


def words_of(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, erratum: int = ERRATUM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the runs of letters, a share of which lose a character, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("_doc", lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("_doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % erratum == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def _steps(words: DataFrame) -> DataFrame:
    """word, n, and for every node on its path the prefix and the branch, which is empty where the word ends."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    return places.select("word", "n", "i", F.substring("word", F.lit(1), F.col("i")).alias("prefix"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("branch"))


def branching_nodes(words: DataFrame) -> DataFrame:
    """prefix, size (words below) and heavy (the branch of the largest child) of every node with two branches or more."""
    edges = _steps(words).groupBy("prefix", "branch").agg(F.count(F.lit(1)).alias("size"))
    largest = F.min(F.when(F.col("branch") != "", F.struct((-F.col("size")).alias("_size"), F.col("branch"))))
    nodes = edges.groupBy("prefix").agg(F.count(F.lit(1)).alias("branches"), F.sum("size").alias("size"), largest.alias("largest"))
    return nodes.where("branches > 1").select("prefix", "size", F.col("largest.branch").alias("heavy"))


def light_edges(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, n, prefix, branch, rest and heavy for every light edge above a word."""
    nodes = materialise(branching_nodes(words), "nodes")
    least = max(hot_rows, (nodes.agg(F.sum("size")).first()[0] or 0) // HOT_NODES)
    steps, hot = _steps(words), F.broadcast(nodes.where(F.col("size") >= least).drop("size"))
    cold = nodes.where(F.col("size") < least).drop("size")
    met = steps.join(hot, "prefix").unionByName(steps.join(hot, "prefix", "left_anti").join(cold, "prefix"))
    rest = F.substring("word", F.col("i") + 2, F.char_length("word"))
    return met.where("branch <> heavy").select("word", "n", "prefix", "branch", rest.alias("rest"), "heavy")


def _probes(min_length: int) -> Column:
    """The words that a light word would meet on the heavy path or at the node."""
    inner = F.col("branch") != ""
    replaced = F.when(inner, F.concat("prefix", "heavy", "rest"))
    skipped = F.when(inner & ~F.col("rest").startswith(F.col("branch")) & (F.char_length("word") > min_length), F.concat("prefix", "rest"))
    inserted = F.concat("prefix", "heavy", "branch", "rest")
    return F.array_compact(F.array(replaced, skipped, inserted))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, n_near and best (struct of minus the count, word) of every word with near words; ``words``: written, word and n."""
    light = materialise(light_edges(words, hot_rows), "light")
    entry = lambda n, word: F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))

    probes = light.select("word", "n", F.explode(_probes(min_length)).alias("probe"))
    hits = probes.join(words.select(F.col("word").alias("probe"), F.col("n").alias("n_other")), "probe")
    ways = F.array(F.struct("word", entry("n_other", "probe").alias("best")), F.struct(F.col("probe").alias("word"), entry("n", "word").alias("best")))
    on_path = hits.select(F.explode(ways).alias("w")).select("w.word", F.lit(1).cast("long").alias("k"), "w.best")

    merged = light.where("branch <> ''").groupBy(F.concat("prefix", F.lit(ANY), "rest").alias("path")).agg(F.array_sort(F.collect_list(entry("n", "word"))).alias("at"))
    met = merged.where(F.size("at") > 1).select("at", F.explode("at").alias("own"))
    other = F.when(F.col("own") == F.col("at")[0], F.col("at")[1]).otherwise(F.col("at")[0])
    beside = met.select(F.col("own.word").alias("word"), (F.size("at") - 1).cast("long").alias("k"), other.alias("best"))

    return on_path.unionByName(beside).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, by pointer jumping over word and form."""
    pointers = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = pointers.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = materialise(pointers.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        discard(pointers)
        pointers = jumped.select("word", "root")
        if jumped.where("_moved").isEmpty():
            return pointers


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, erratum: int = ERRATUM, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = materialise(words_of(docs, min_length, min_count, erratum, doc_id, text), "words")
    found = words.join(near_words(words, min_length, hot_rows), "word", "left")
    strong = -F.col("best.minus") >= ratio * F.col("n")
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    formed = materialise(formed, "formed")
    ends = _roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

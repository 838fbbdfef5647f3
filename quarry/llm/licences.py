"""Licence scans [native]: a trained classifier of paragraphs names licence families, and a comparison with templates confirms them.

The model is a softmax regression over sparse word n-grams (one and two words),
hashed by CRC-32 into ``BUCKETS``, with the families and an ``unknown`` class.  It
is trained here, on the driver:

* families: paragraphs of the licences themselves (``licence_texts``), with leads,
  neighbouring words and lost words;
* unknown: sentences near to notices, and paragraphs of the corpus that hold a cue
  word and match no template, at most ``SAMPLE_ROWS`` of ``SAMPLE_DOCS`` documents,
  those with the smallest hashes, and up to ``SAMPLE_CHARS`` characters of each.

Notices, sentences and paragraphs are dealt to ``FOLDS`` folds with all their
variants.  Each fold is predicted by a model of the others; these predictions set
the temperature, so that probabilities hold for notices never seen, and their
calibration error goes along with the model, which then learns from all.

Scanning uses SQL functions only, within the row.  A text is read twice: by its
lines, and by its blocks of two or more lines, for notices that are wrapped; a
line without letters and digits, as a lone comment mark, ends a block.  Lines and
blocks with a cue word are cut into words and n-grams, whose weights are found by
their bucket.  Its triples are looked up in an index of all templates' triples; a
family is confirmed when the paragraph holds ``CONFIRM`` of the triples of one of its
templates, and two at least (or all, of three words).  A paragraph that the model does
not leave unknown gets the likeliest confirmed family, which may be its second guess,
or else its first guess, unconfirmed.  A paragraph without a cue word is unknown by
definition.  The work of a text grows with its lines and words (and n log n for the
order of n lines).  Nothing is shuffled.

Defined cases: null and empty texts are one empty paragraph; equal rows get equal
results; ties between classes go to the first in the order of the families;
other columns, of any name, are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import random
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii
from .licence_texts import CUES, LEADS, NEAR_MISSES, TEMPLATES

#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_CHARS = 1_000, 1_500, 2_000
BUCKETS, FOLDS = 8_192, 3
CONFIRM = 0.5
#: Parts of the index of template triples.
TRIPLE_BUCKETS = 2_048
UNKNOWN = "unknown"

_LOWER = str.maketrans(UPPER, LOWER)
def _cue_pattern() -> str:
    """A cue word between characters that are not of a word; its first letter comes first, so most positions fail at once."""
    by_letter = itertools.groupby(CUES, lambda w: w[0])
    rests = [f"(?<={letter})(?:{'|'.join(w[1:] for w in words)})" for letter, words in by_letter]
    return f"[{''.join(sorted({w[0] for w in CUES}))}](?<![a-z0-9].)(?:{'|'.join(rests)})(?![a-z0-9])"


CUE_PATTERN = _cue_pattern()
#: Comment marks that are words, at the start of a line; all others are separators of words.
COMMENT_WORDS = r"(?m)^[^\S\n]*(?:dnl|rem|c)(?=\s)"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.translate(_LOWER)) if w]


def grams_of(words: list[str], n: int) -> set[str]:
    """The distinct runs of n words."""
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def needed(triples: int) -> int:
    """How many triples of a template confirm it."""
    return max(min(triples, 2), int(np.ceil(CONFIRM * triples)))


def is_notice(paragraph: str) -> bool:
    """Whether a template of any family confirms it."""
    own = grams_of(words_of(paragraph), 3)
    return any(len(t & own) >= needed(len(t)) for t in _triples())


def _triples() -> list[set[str]]:
    return [grams_of(words_of(t), 3) for notices in TEMPLATES.values() for t in notices]


@dataclass(frozen=True)
class LicenceModel:
    """classes: families and UNKNOWN; weights (buckets, classes) and bias, divided by the temperature already; the out-of-fold calibration error and accuracy."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    calibration_error: float
    accuracy: float


def buckets_of(paragraph: str) -> list[int]:
    words = words_of(paragraph)
    return sorted(zlib.crc32(g.encode()) % BUCKETS for g in grams_of(words, 1) | grams_of(words, 2))


def training_rows(background: list[str], seed: int = 7) -> list[tuple[str, str, int]]:
    """(paragraph, class, source) rows; rows with one source are variants of one text."""
    rng = random.Random(seed)
    prose = list(dict.fromkeys(p for p in background if p.strip()))
    cued = [p for p in prose if re.search(CUE_PATTERN, p.translate(_LOWER)) and not is_notice(p)]
    filler = [w for p in prose for w in p.split()] or "and so it was in the end of that long day".split()
    some = lambda most: " ".join(rng.choice(filler) for _ in range(rng.randint(0, most)))
    rows, source = [], itertools.count()
    for family, notices in TEMPLATES.items():
        for notice in notices:
            own, words = next(source), notice.split()
            rows += [(f"{lead}{notice}", family, own) for lead in rng.sample(LEADS, 3)]
            rows += [(f"{some(12)} {rng.choice(LEADS)}{notice} {some(12)}", family, own) for _ in range(5)]
            if len(words) > 12:
                rows += [(" ".join(w for w in words if rng.random() > 0.1), family, own) for _ in range(2)]
                rows.append((" ".join(words[: 2 * len(words) // 3]), family, own))
    for miss in NEAR_MISSES:
        own = next(source)
        rows += [(f"{some(10)} {miss} {some(10)}", UNKNOWN, own) for _ in range(6)]
    rows += [(f"{some(8)} {rng.choice(CUES)} {some(8)}", UNKNOWN, next(source)) for _ in range(200)]
    rows += [(p, UNKNOWN, next(source)) for p in (cued if len(cued) <= SAMPLE_ROWS else rng.sample(cued, SAMPLE_ROWS))]
    return rows


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _learn(x: np.ndarray, y: np.ndarray, classes: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent with momentum; a class of n rows weighs as much as its root of n."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    onehot = np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.sqrt(np.maximum(np.bincount(y, minlength=classes), 1)))[y].astype(np.float32)
    share /= share.sum()
    for _ in range(steps):
        g = (_softmax(x @ w + b) - onehot) * share[:, None]
        vw, vb = 0.9 * vw + x.T @ g + decay * w, 0.9 * vb + g.sum(0)
        w -= rate * vw
        b -= rate * vb
    return w, b


def calibration_error(p: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    """Mean distance of the top probability from the share that is right, by bins of that probability."""
    top, right = p.max(1), p.argmax(1) == y
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[at == k].mean() - right[at == k].mean()) * (at == k).mean() for k in range(bins) if (at == k).any()))


def train(background: list[str], steps: int = 120, rate: float = 1.0, decay: float = 1e-3) -> LicenceModel:
    rows = training_rows(background)
    classes = [*TEMPLATES, UNKNOWN]
    found = [buckets_of(p) for p, _, _ in rows]
    count = np.bincount([b for f in found for b in set(f)], minlength=BUCKETS)
    kept = sorted({b for notices in TEMPLATES.values() for t in notices for b in buckets_of(t)} | set(np.flatnonzero(count >= 5).tolist()))
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, f in enumerate(found):
        at = column[f]
        np.add.at(x[i], at[at >= 0], 1)
    y = np.array([classes.index(c) for _, c, _ in rows])
    fold = np.array([zlib.crc32(b"%d" % s) % FOLDS for _, _, s in rows])
    scores = np.zeros((len(rows), len(classes)), np.float32)
    for k in range(FOLDS):
        w, b = _learn(x[fold != k], y[fold != k], len(classes), steps, rate, decay)
        scores[fold == k] = x[fold == k] @ w + b
    loss = lambda t: float(-np.log(_softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean())
    temperature = min(np.linspace(0.25, 8, 63), key=loss)
    p = _softmax(scores / temperature)
    w, b = _learn(x, y, len(classes), steps, rate, decay)
    weights = np.zeros((BUCKETS, len(classes)))
    weights[kept] = np.round(w / temperature, 4)
    return LicenceModel(classes, weights, np.round(b / temperature, 4).astype(np.float64), calibration_error(p, y), float((p.argmax(1) == y).mean()))


# ---------------------------------------------------------------- paragraphs


def background_of(docs: DataFrame, text: str = "text") -> list[str]:
    """The bounded sample of paragraphs with a cue: lines, and blocks of two or more lines, of about SAMPLE_DOCS documents drawn by hash."""
    texts = docs.select(F.struct("*").alias("row")).select(lower_ascii(F.col("row")[text]).alias("t")).where(F.col("t").isNotNull())
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    drawn = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 40)) < int(share * (1 << 40)))
    units = F.when(F.rlike("t", F.lit(CUE_PATTERN)), _units(F.split("t", "\n")))
    both = drawn.select(F.explode(F.concat(F.transform(units["lines"], lambda x: x["p"]), F.transform(units["blocks"], lambda x: x["p"]))).alias("p"))
    cut = both.select(F.substring("p", 1, SAMPLE_CHARS).alias("p")).distinct()
    return [r.p for r in cut.orderBy(F.xxhash64("p"), "p").limit(2 * SAMPLE_ROWS).collect()]


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _units(lines: Column) -> Column:
    """struct(lines, blocks) of what holds a cue, each an array of struct(position, stop, p)."""

    def cued(lines: Column) -> Column:
        numbered = F.transform(lines, lambda p, i: F.struct(i.alias("position"), (i + 1).alias("stop"), p.alias("p")))
        return F.filter(numbered, lambda x: F.rlike(x["p"], F.lit(CUE_PATTERN)))

    return _bind(lines, lambda lines: _bind(cued(lines), lambda c: F.struct(c.alias("lines"), _blocks(lines, c).alias("blocks"))))


def _blocks(lines: Column, cued: Column) -> Column:
    """The blocks of two or more lines that hold a cue; p without the comment words at the starts of lines.

    Borders and cued lines are sorted together once: the border before a block's first
    cue and that behind its last one are their neighbours there.
    """
    mark = lambda i, cue: F.struct(i.cast("int").alias("i"), F.lit(cue).alias("cue"))
    blank = F.filter(F.transform(lines, lambda p, i: F.when(~F.rlike(p, F.lit(r"[\p{L}\p{N}]")), mark(i, False))), lambda m: m.isNotNull())
    ends = F.array(mark(F.lit(-1), False), mark(F.size(lines), False))
    sorted_marks = F.array_sort(F.concat(ends, blank, F.transform(cued, lambda x: mark(x["position"], True))))

    def held(marks: Column) -> Column:
        steps = F.zip_with(F.slice(marks, F.lit(1), F.size(marks) - 1), F.slice(marks, F.lit(2), F.size(marks) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        first = F.transform(F.filter(steps, lambda s: ~s["a"]["cue"] & s["b"]["cue"]), lambda s: s["a"]["i"] + 1)
        last = F.transform(F.filter(steps, lambda s: s["a"]["cue"] & ~s["b"]["cue"]), lambda s: s["b"]["i"])
        return F.zip_with(first, last, lambda position, stop: F.struct(position.alias("position"), stop.alias("stop")))

    several = F.filter(_bind(sorted_marks, held), lambda e: e["stop"] > e["position"] + 1)
    joined = lambda e: F.array_join(F.slice(lines, e["position"] + 1, e["stop"] - e["position"]), "\n")
    return F.transform(several, lambda e: F.struct(e["position"].alias("position"), e["stop"].alias("stop"), F.regexp_replace(joined(e), COMMENT_WORDS, "").alias("p")))


# ---------------------------------------------------------------- scanning


def _runs(words: Column, n: int) -> Column:
    """The runs of n words, as they come."""
    part = lambda k: F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    out = part(0)
    for k in range(1, n):
        out = F.zip_with(out, part(k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _classified(units: Column, model: LicenceModel) -> Column:
    """struct(position, stop, family, score, confirmed) of each unit."""
    used = np.flatnonzero(np.abs(model.weights).max(1) > 0)
    row = np.full(BUCKETS, 0)
    row[used] = np.arange(1, len(used) + 1)  # 0: no weights
    rows, weights = _constant(row.tolist(), "array<int>"), _constant(model.weights[used].tolist(), "array<array<double>>")
    bias, classes = _constant(model.bias.tolist(), "array<double>"), _constant(model.classes, "array<string>")
    templates = [(model.classes.index(c) + 1, grams_of(words_of(n), 3)) for c, notices in TEMPLATES.items() for n in notices]
    owners, needs = _constant([c for c, _ in templates], "array<int>"), _constant([needed(len(t)) for _, t in templates], "array<int>")
    postings: list[dict[str, list[int]]] = [{} for _ in range(TRIPLE_BUCKETS)]
    for k, (_, triples) in enumerate(templates, 1):
        for t in triples:
            postings[zlib.crc32(t.encode()) % TRIPLE_BUCKETS].setdefault(t, []).append(k)
    index = _constant([[{"t": t, "of": ks} for t, ks in sorted(p.items())] for p in postings], "array<array<struct<t: string, of: array<int>>>>")

    def scored(words: Column) -> Column:
        grams = F.concat(F.array_distinct(words), F.array_distinct(_runs(words, 2)))
        at = F.filter(F.transform(grams, lambda g: F.element_at(rows, (F.crc32(g.cast("binary")) % BUCKETS + 1).cast("int"))), lambda i: i > 0)
        return F.aggregate(F.array_sort(at), bias, lambda acc, i: F.zip_with(acc, F.element_at(weights, i), lambda a, b: a + b))

    def confirmed(words: Column) -> Column:
        """The classes that have a template of which the words hold enough triples."""
        posted = lambda t: F.filter(F.element_at(index, (F.crc32(t.cast("binary")) % TRIPLE_BUCKETS + 1).cast("int")), lambda e: e["t"] == t)
        hits = F.flatten(F.transform(F.array_distinct(_runs(words, 3)), lambda t: F.flatten(F.transform(posted(t), lambda e: e["of"]))))
        enough = lambda h: F.filter(F.array_distinct(h), lambda k: F.size(F.filter(h, lambda x: x == k)) >= F.element_at(needs, k))
        return _bind(hits, lambda h: F.array_distinct(F.transform(enough(h), lambda k: F.element_at(owners, k))))

    def judged(x: Column, words: Column, z: Column) -> Column:
        top = F.array_max(z)
        first = F.array_position(z, top).cast("int")
        of = F.when(F.element_at(classes, first) != UNKNOWN, confirmed(words))

        def chosen(sure: Column) -> Column:
            likeliest = F.array_max(F.transform(sure, lambda k: F.struct(F.element_at(z, k).alias("z"), (-k).alias("k"))))
            best = F.coalesce(-likeliest["k"], first)
            share = _bind(top, lambda m: F.exp(F.element_at(z, best) - m) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
            return F.struct(x["position"].alias("position"), x["stop"].alias("stop"), F.element_at(classes, best).alias("family"), share.alias("score"), F.coalesce(F.size(sure) > 0, F.lit(False)).alias("confirmed"))

        return _bind(F.coalesce(of, F.expr("cast(array() AS array<int>)")), chosen)

    words = lambda x: F.filter(F.split(x["p"], "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(units, lambda x: _bind(words(x), lambda w: _bind(scored(w), lambda z: judged(x, w, z))))


def scan(docs: DataFrame, model: LicenceModel, text: str = "text") -> DataFrame:
    """row (all columns of ``docs``), n_paragraphs (lines), and found (lines with a cue) and wrapped (blocks with a cue): arrays of struct(position, stop, family, score, confirmed), in lines."""
    base = docs.select(F.struct("*").alias("row"))
    lower = base.select("row", lower_ascii(F.coalesce(F.col("row")[text], F.lit(""))).alias("lower"))
    some = F.rlike("lower", F.lit(CUE_PATTERN))
    cut = lower.select("row", F.size(F.split("lower", "\n")).cast("long").alias("n_paragraphs"), F.when(some, _units(F.split("lower", "\n"))).alias("units"))
    none = F.expr("cast(array() AS array<struct<position: int, stop: int, family: string, score: double, confirmed: boolean>>)")
    found = lambda part: F.coalesce(_classified(F.col("units")[part], model), none)
    return cut.select("row", "n_paragraphs", found("lines").alias("found"), found("blocks").alias("wrapped"))


def summary(scanned: DataFrame) -> list[Column]:
    """n_paragraphs, n_cued (lines), n_licensed (confirmed lines, and blocks without a confirmed line of their family), licences (confirmed families, sorted and comma-joined), family and score of the most likely confirmed paragraph (of equal ones the first line's, then the last family's), else unknown and null."""
    confirmed = lambda found: F.filter(found, lambda x: (x["family"] != UNKNOWN) & x["confirmed"])
    covered = lambda b, lines: F.exists(lines, lambda x: (x["family"] == b["family"]) & (x["position"] >= b["position"]) & (x["position"] < b["stop"]))
    good = _bind(confirmed("found"), lambda lines: F.concat(lines, F.filter(confirmed("wrapped"), lambda b: ~covered(b, lines))))
    top = F.array_max(F.transform(good, lambda x: F.struct(x["score"].alias("score"), (-x["position"]).alias("order"), x["family"].alias("family"))))
    return [
        F.col("n_paragraphs"),
        F.size("found").cast("long").alias("n_cued"),
        F.size(good).cast("long").alias("n_licensed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))), ",").alias("licences"),
        F.coalesce(top["family"], F.lit(UNKNOWN)).alias("family"),
        top["score"].alias("score"),
    ]

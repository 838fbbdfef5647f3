"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each document's text gives ``len(NAMES)`` statistics of its characters, words and
lines, taken to a scale on which good prose is near a normal distribution (logs
of counts, log odds of shares); the texts of a batch are taken together, and equal
words, pairs and lines are found by 64-bit hashes.  For each class the sums of the
statistics and of their products are gathered over at most ``FIT_ROWS`` labelled
rows, those with the smallest hashes of their id, by a distributed sum, of which
some hundred numbers come to the driver; no other text is read for the model.  The class covariance is shrunk:
(1 - POOL) of its own and POOL of the pooled covariance, then RIDGE of it is
replaced by its mean variance on the diagonal, all on statistics scaled to unit
variance.  Its Cholesky factor is computed once and goes along with the model; a
document's score is the logistic function of the difference of the classes' log
densities (Mahalanobis distances and log determinants) and log priors, tempered
by TEMPER, since the statistics are not independent samples, and by n / (n + FEW)
for a text of n words, since a few words say little.

Defined cases: null and empty texts have the statistics of no words and get a
score like others; labels other than 0 and 1, and labels of no document, are not
used; repeated labels of one id count as often as they come; if a class has no
row, the score is the other's share of the labelled rows, and 0.5 without any;
only the text is read for a score; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, pieces
from .hashing import BASE, mix, range_hashes

NAMES = [
    "log_words", "log_word_length", "log_word_spread", "upper", "lower", "digit", "non_ascii", "stop_mark", "symbol", "blank", "newline",
    "distinct_words", "distinct_pairs", "top_word", "twins", "byte_entropy", "odd_words", "distinct_lines", "log_line_length", "no_words",
]
#: Share of the pooled covariance in a class's, and of the mean variance in its diagonal.
POOL, RIDGE = 0.1, 0.05
#: Factor on the log-density difference.
TEMPER = 0.25
#: With so many words the statistics count half.
FEW = 8
#: Most labelled rows that the model learns from.
FIT_ROWS = 20_000

_CLASS = np.full(256, 5)  # symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _mark in b".,;:?'-()\"":
    _CLASS[_mark] = 4
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 6, 7
#: Bytes between words, and bytes at the end of a word that neither go on in small letters nor end a sentence.
_BLANK, _ODD_END = np.isin(np.arange(256), list(b" \t\n\r\x0b\f")), ~((np.arange(256) >= 0x61) | np.isin(np.arange(256), list(b".,;:?")))


_U = np.uint64
#: Bytes of texts that are taken together.
_SPAN = 1 << 20


def _repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each document has, and how often its most frequent one comes."""
    if not len(hashes):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    bits = _U(64 - max(n - 1, 1).bit_length())
    key = np.sort(doc.astype(_U) << bits | hashes >> (_U(64) - bits))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[starts] >> bits).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.diff(np.append(starts, len(key))))
    return np.bincount(owner, minlength=n), top


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics_of(texts: list[str | None]) -> np.ndarray:
    """The values of NAMES for each text."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(parts)
    if not n:
        return np.zeros((0, len(NAMES)))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)  # a newline ends each text and belongs to none
    length = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    begins = ends - length
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    kinds = np.stack([hist[:, _CLASS == k].sum(1) for k in range(8)], 1)
    size = np.maximum(length, 1)
    share = hist / size[:, None]
    entropy = -(share * np.log(np.where(hist > 0, share, 1))).sum(1)

    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_BLANK[data], [False]]).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    doc = np.searchsorted(ends, first)
    words = np.bincount(doc, minlength=n)
    wide = (last - first).astype(np.float64)
    mean = np.bincount(doc, wide, n) / np.maximum(words, 1)
    spread = np.sqrt(np.bincount(doc, np.square(wide - mean[doc]), n) / np.maximum(words, 1))
    hashes = range_hashes(data, first, last, _SPAN)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    distinct, top = _repeats(hashes, doc, n)
    pairs, _ = _repeats(mix(hashes[inner] * _U(BASE) + hashes[inner + 1]), doc[inner], n)
    twins = np.bincount(doc[inner[hashes[inner] == hashes[inner + 1]]], minlength=n)
    odd = np.bincount(doc[_ODD_END[data[last - 1]]], minlength=n)

    stops = np.flatnonzero(data == 10)
    of_line = np.searchsorted(ends, stops)
    lines = np.bincount(of_line, minlength=n)
    distinct_lines, _ = _repeats(range_hashes(data, np.concatenate([[0], stops[:-1] + 1]), stops, _SPAN), of_line, n)

    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 3]
    gaps = np.maximum(words - 1, 0)
    return np.stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), _odds(kinds[:, 0], letters), _odds(kinds[:, 1], size), _odds(kinds[:, 2], size), _odds(kinds[:, 3], size), _odds(kinds[:, 4], size), _odds(kinds[:, 5], size), _odds(kinds[:, 6], size), _odds(kinds[:, 7], size),
        _odds(distinct, words), _odds(pairs, gaps), _odds(top, words), _odds(twins, gaps), entropy, _odds(odd, words), _odds(distinct_lines, lines), np.log1p(length / lines), (words == 0).astype(np.float64),
    ], 1)


def _in_parts(text: pa.Array) -> Iterator[np.ndarray]:
    """The statistics of some texts at a time, of one that is longer alone."""
    for part in pieces(iter([pa.RecordBatch.from_arrays([text], ["t"])]), "t", _SPAN):
        yield statistics_of(part.column(0).to_pylist())


@dataclass(frozen=True)
class Model:
    """Per class: prior, mean, the inverse of the Cholesky factor and the log determinant; scaling comes first."""

    centre: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    means: np.ndarray
    whiteners: np.ndarray
    log_dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.rows.sum()
        if (self.rows < 2).any():
            return np.full(len(x), self.rows[1] / total if total else 0.5)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (np.square((z - m) @ w.T).sum(1) + d) for m, w, d in zip(self.means, self.whiteners, self.log_dets, strict=True)]
        n = np.expm1(x[:, 0])
        margin = TEMPER * n / (n + FEW) * (density[1] - density[0]) + math.log(self.rows[1] / self.rows[0])
        return 0.5 * (1 + np.tanh(0.5 * margin))


def model_of(rows: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """From each class's number of rows, sums (2, d) and sums of products (2, d, d)."""
    d = sums.shape[1]
    total = max(rows.sum(), 1)
    centre = sums.sum(0) / total
    spread = np.maximum(np.diag(products.sum(0)) / total - centre**2, 0)
    scale = np.where(spread > 1e-12, np.sqrt(spread), 1.0)
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for c in range(2):
        if rows[c]:
            means[c] = (sums[c] / rows[c] - centre) / scale
            moved = products[c] / rows[c] - np.outer(sums[c], sums[c]) / rows[c] ** 2
            covs[c] = moved / np.outer(scale, scale)
    pooled = np.tensordot(rows, covs, 1) / total
    whiteners, dets = np.zeros((2, d, d)), np.zeros(2)
    for c in range(2):
        cov = (1 - POOL) * covs[c] + POOL * pooled
        cov = (1 - RIDGE) * cov + RIDGE * (np.trace(cov) / d + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiteners[c], dets[c] = np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
    return Model(centre, scale, rows.astype(np.float64), means, whiteners, dets)


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learnt from: CRC-32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that are not held out, at most ``most``."""
    d = len(NAMES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    share = min(1.0, 2 * most / max(marks.count(), 1))  # about twice as many as are wanted pass by their hash
    passed = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    drawn = materialise(passed.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)), "_id", "_label").limit(most), "labels")  # so few that they can be broadcast
    given = docs.select(F.struct("*").alias("row")).select(F.col("row")[doc_id].alias("_doc"), F.col("row")[text].alias("_text"))
    texts = given.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("_label", "_text")

    def sums(batches):
        held = np.zeros((2, 1 + d + len(upper)))
        a, b = np.array(upper).T
        for batch in pieces(batches, "_text", _SPAN):
            x = statistics_of(batch.column("_text").to_pylist())
            y = batch.column("_label").to_numpy(zero_copy_only=False)
            for c in range(2):
                own = x[y == c]
                held[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own)[a, b]])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], names=["c", "s"])

    parts = texts.mapInArrow(sums, "c int, s array<double>")
    rows = parts.select("c", F.posexplode("s").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * (d + 1) / 2) numbers
    found = np.zeros((2, 1 + d + len(upper)))
    for r in rows:
        found[r.c, r.at] = r.v
    products = np.zeros((2, d, d))
    for c in range(2):
        for v, (i, j) in zip(found[c, 1 + d :], upper, strict=True):
            products[c, i, j] = products[c, j, i] = v
    return model_of(found[:, 0], found[:, 1 : 1 + d], products)


def scorer(model: Model):
    """An Arrow function from text to score; null scores do not occur."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *map(model.score, _in_parts(text))]), pa.float64())

    return score


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their columns."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", scorer(model)(F.col("row")[text]).alias("score")).where(F.col("score") >= least).select("row.*")

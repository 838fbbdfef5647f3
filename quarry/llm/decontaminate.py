"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once; hits are mapped to the original.

Normalising takes A-Z to lower case and reads words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
from the UTF-8 bytes.  Each distinct word of the items gets a number, other words
share -1, so an item's windows and the texts are runs of numbers, and places in
them are word numbers.  A window is ``window`` consecutive words of an item, or all
of an item that has fewer.  Word numbers lead back to byte offsets of the original.

The automaton is five arrays, built on the driver level by level: edges by state
and word, failure links, outputs and what they say; about 25 bytes for each state,
at most ``window`` states for each window.  It is broadcast.  The texts of a batch
are one run of numbers with -1 between texts; it is cut into pieces that begin a
window early, and all pieces are scanned in lock-step.  Words of hits are compared
byte by byte, since the numbers of words come from their hashes.

An automaton has at most ``WINDOWS`` windows (250 MB); more windows go to further
automata, each with a pass of its own, whose hits are merged by document.

Defined cases: null and empty texts and items have no words and no hits; an item
without an id marks words but is not listed; equal items each count; repeated
ids count once a document; an empty benchmark marks nothing; other columns, of any
name, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .common import pieces
from .hashing import range_hashes

WINDOW = 10
#: Windows of one automaton.
WINDOWS = 1_000_000
#: Words of a piece, and bytes of text whose words are scanned together.
PIECE, TEXT_BYTES = 128, 1 << 20

#: Bytes of words as themselves (A-Z in lower case), all others as blanks.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class Words:
    """The words of some texts, one after another: their bytes, ranges, and the first word of each text (and the end)."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    begins: np.ndarray

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.first, self.last)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()


def words(texts: list[str | None]) -> Words:
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]).translate(_WORD_BYTES), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], data != 0x20, [False]]).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    return Words(data, first, last, np.searchsorted(first, np.cumsum([0, *[len(p) + 1 for p in parts]])))


def word_spans(text: str) -> np.ndarray:
    """(n, 2) byte offsets of the words in the original."""
    found = words([text])
    return np.stack([found.first, found.last], 1)


@dataclass
class Automaton:
    """Words by hash with their bytes; edges (state * words + word) with their ends; failure links; the nearest output of a state, the next one after it, and its length; items by state."""

    hashes: np.ndarray
    spelling: np.ndarray
    starts: np.ndarray
    edges: np.ndarray
    ends: np.ndarray
    fail: np.ndarray
    output: np.ndarray
    following: np.ndarray
    length: np.ndarray
    item_from: np.ndarray
    item_of: np.ndarray
    items: list[str | None]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after a word, -1 being none that is known."""
        out = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(word >= 0)
        state = state[todo]
        while len(todo):
            key = state * len(self.hashes) + word[todo]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[at] == key
            out[todo[there]] = self.ends[at[there]]
            more = ~there & (state > 0)
            todo, state = todo[more], self.fail[state[more]].astype(np.int64)
        return out

    def numbers(self, found: Words) -> np.ndarray:
        """The numbers of words, by hash; -1 for others."""
        if not len(self.hashes):
            return np.full(len(found.first), -1)
        own = found.hashes()
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, at, -1)

    def hits(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first word, end and state of every occurrence of a window."""
        numbers = self.numbers(found)
        first, stop, state = self._scan(numbers, found.begins)
        hit = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(hit, first, 1)
        np.add.at(hit, stop, -1)
        odd = [i for i in np.flatnonzero(np.cumsum(hit)[:-1]).tolist() if found.bytes_of(i) != self.spelling[self.starts[numbers[i]] : self.starts[numbers[i] + 1]].tobytes()]
        if odd:  # another word with the hash of a known one
            numbers[odd] = -1
            first, stop, state = self._scan(numbers, found.begins)
        return first, stop, state

    def _scan(self, numbers: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not len(self.edges) or not (numbers >= 0).any():
            return none, none, none
        # One run of all texts, a gap before each; places in it to and fro.
        owner = np.searchsorted(begins, np.arange(len(numbers)), side="right") - 1
        run = np.full(len(numbers) + len(begins) + 1, -1)
        place = np.arange(len(numbers)) + owner + 1
        run[place] = numbers
        back = np.zeros(len(run), np.int64)
        back[place] = np.arange(len(numbers))
        early = int(self.length.max()) - 1
        starts = np.arange(0, len(run), PIECE)
        state = np.zeros(len(starts), np.int64)
        ends, states = [], []
        for j in range(-early, PIECE):
            at = starts + j
            inside = (at >= 0) & (at < len(run))
            state = self.step(state, np.where(inside, run[np.clip(at, 0, len(run) - 1)], -1))
            if j >= 0:
                out = np.flatnonzero(inside & (self.output[state] > 0))
                ends.append(at[out])
                states.append(self.output[state[out]].astype(np.int64))
        end, node = np.concatenate(ends), np.concatenate(states)
        firsts, stops, nodes = [], [], []
        while len(end):
            stop = back[end] + 1
            firsts.append(stop - self.length[node])
            stops.append(stop)
            nodes.append(node)
            node = self.following[node].astype(np.int64)
            end, node = end[node > 0], node[node > 0]
        return (np.concatenate(firsts), np.concatenate(stops), np.concatenate(nodes)) if firsts else (none, none, none)

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        """The number of words, hit word numbers in order, and items, sorted, of each text."""
        found = words(texts)
        first, stop, state = self.hits(found)
        marks = np.zeros(len(found.first) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, stop, -1)
        hit = np.flatnonzero(np.cumsum(marks)[:-1])
        edges = np.searchsorted(hit, found.begins)
        owner = np.searchsorted(found.begins, first, side="right") - 1
        listed: dict[int, set[str]] = {}
        for text, node in set(zip(owner.tolist(), state.tolist(), strict=True)):
            own = (self.items[i] for i in self.item_of[self.item_from[node] : self.item_from[node + 1]].tolist())
            listed.setdefault(text, set()).update(i for i in own if i is not None)
        sizes = np.diff(found.begins).tolist()
        return [(n, hit[a:b] - begin, sorted(listed.get(i, ()))) for i, (n, a, b, begin) in enumerate(zip(sizes, edges[:-1].tolist(), edges[1:].tolist(), found.begins.tolist(), strict=False))]


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Automaton:
    """The automaton of all windows of the items."""
    found = words([text for _, text in items])
    own = found.hashes()
    hashes, sample, number = np.unique(own, return_index=True, return_inverse=True)
    spelling = [found.bytes_of(i) for i in sample.tolist()]
    size = np.diff(found.begins)
    count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), count)
    start = found.begins[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size[item], window)
    edges, ends, parents, levels = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    state, states = np.zeros(len(item), np.int64), 1
    for d in range(int(length.max(initial=0))):
        alive = np.flatnonzero(length > d)
        key, at = np.unique(state[alive] * len(hashes) + number[start[alive] + d], return_inverse=True)
        state[alive] = states + at
        edges.append(key)
        ends.append(states + np.arange(len(key)))
        parents.append(key // len(hashes))
        levels.append(np.full(len(key), d + 1))
        states += len(key)
    key, end = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (edges, ends))
    order = np.argsort(key, kind="stable")
    made = np.zeros(states, np.int16)
    made[state] = length
    pairs = np.unique(np.stack([state, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    out = Automaton(
        hashes, np.frombuffer(b"".join(spelling), np.uint8), np.cumsum([0, *map(len, spelling)]), key[order], end[order].astype(np.int32), np.zeros(states, np.int32), np.zeros(states, np.int32), np.zeros(states, np.int32), made,
        np.searchsorted(pairs[:, 0], np.arange(states + 1)).astype(np.int32), pairs[:, 1].astype(np.int32), [i for i, _ in items],
    )
    depth, parent = np.concatenate(levels), np.concatenate(parents)
    word = np.concatenate([[-1], key - parent[1:] * len(hashes)])
    for d in range(1, int(depth.max()) + 1):  # links of a level lead to levels above it
        own = np.flatnonzero(depth == d)
        if d > 1:
            out.fail[own] = out.step(out.fail[parent[own]].astype(np.int64), word[own])
        out.following[own] = out.output[out.fail[own]]
        out.output[own] = np.where(made[own] > 0, own, out.following[own])
    return out


def automata(rows: Iterator[tuple[str | None, str | None]], window: int, most: int) -> Iterator[Automaton]:
    """Of all items, in automata of about ``most`` windows; one ends between items."""
    held, windows = [], 0
    for item, text in rows:
        held.append((item, text))
        windows += max(len(words([text]).first) - window + 1, 1)
        if windows >= most:
            yield build(held, window)
            held, windows = [], 0
    if held:
        yield build(held, window)


_SCAN_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scanner(automaton):
    """An Arrow function from text to its words, hit word numbers and items; ``automaton``: a broadcast."""

    @F.arrow_udf(from_arrow_type(_SCAN_TYPE))
    def scan(text: pa.Array) -> pa.Array:
        found: list = []
        for part in pieces(iter([pa.RecordBatch.from_arrays([text], ["t"])]), "t", TEXT_BYTES):
            found += automaton.value.scan(part.column(0).to_pylist())
        return pa.array(found, _SCAN_TYPE)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most: int = WINDOWS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with n_words, hits (word numbers) and items (ids as strings), sorted."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator()
    shards = [spark.sparkContext.broadcast(a) for a in automata(((r[0], r[1]) for r in rows), window, most)] or [spark.sparkContext.broadcast(build([], window))]
    base = docs.select(F.struct("*").alias("row"))
    if len(shards) == 1:
        return base.withColumn("found", _scanner(shards[0])(F.col("row")[text])).select("row", "found.*")
    keyed = base.select("row", F.xxhash64(F.to_json(F.struct("row"))).alias("key")).withColumn("key2", F.xxhash64(F.lit(1), F.to_json(F.struct("row"))))
    passes = None
    for shard in shards:
        one = keyed.select("key", "key2", _scanner(shard)(F.col("row")[text]).alias("found")).where(F.size("found.hits") > 0).select("key", "key2", "found.hits", "found.items")
        passes = one if passes is None else passes.unionByName(one)
    merged = passes.groupBy("key", "key2").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("hits", "items")])
    none = spark.sparkContext.broadcast(build([], window))
    whole = keyed.withColumn("n_words", _scanner(none)(F.col("row")[text])["n_words"]).join(merged, ["key", "key2"], "left")
    return whole.select("row", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


@F.arrow_udf(from_arrow_type(_SPAN))
def byte_spans(text: pa.Array, hits: pa.Array) -> pa.Array:
    """Runs of hit words as byte ranges of the original text."""
    out = []
    for one, at in zip(text, hits, strict=True):
        at = np.array(at.as_py() or [], np.int64)
        if not len(at):
            out.append([])
            continue
        spans = word_spans(one.as_py())
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        out.append([{"start": int(a), "stop": int(b)} for a, b in zip(spans[first, 0], spans[last, 1], strict=True)])
    return pa.array(out, _SPAN)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    return scan(docs, benchmark, text, window).where(F.size("hits") == 0).select("row.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

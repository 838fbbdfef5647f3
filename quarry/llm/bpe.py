"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

1. Each block of documents (16 MB of text, in segments of 8 MB) is split into
   pre-tokens with their positions, by vectorised character classes that give the
   matches of ``public_tokenizers.PATTERN``, and these are coded by the block's
   sorted dictionary of distinct words.  The blocks' position codes and
   dictionaries are written once to the shared folder.
2. The dictionaries are exploded into words that are shuffled by range: one
   block's words between two splitters make a front-coded list, and equal words of
   all blocks meet in one bucket.  A bucket's lists are streamed, each distinct
   word is encoded once, by ranks, all new words of a batch in lock-step, and its
   ids join back to the blocks that sent it, in the order of the words.
3. A block's ids and its position codes meet by block and are reassembled by
   position.

A bucket is given about ``BUCKET_WORDS`` distinct words, so a frequent word, which
every block sends, adds one entry to what a task holds; beyond ``CACHE_WORDS`` a
task forgets the words it has seen, which costs time and changes nothing.  The
lists that are shuffled are as many as blocks times buckets, as in any shuffle,
and never more than dictionary entries.  The number of distinct words and the
splitters come from all words of all blocks with a CRC-32 divisible by ``EVERY``,
thinned to about ``SAMPLES``; they set the buckets' sizes and nothing else.

Decoding joins the ids of a batch with the token-byte table, which has a row for
each token of the vocabulary and is broadcast.

Defined cases: null and empty texts have no ids; equal rows are encoded each; an
empty table gives an empty result; ids that have no row in the token-byte table
raise on decoding; other columns, of any name, are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialise, pieces, release

#: Bytes of text in a block, in a segment of it, and in what is split together.
BLOCK_BYTES, SEGMENT_BYTES, PIECE_BYTES = 16 << 20, 8 << 20, 1 << 20
#: Distinct words of a bucket, and words whose ids a task holds.
BUCKET_WORDS, CACHE_WORDS = 100_000, 400_000
#: One distinct word in so many is sampled, and about so many reach the driver.
EVERY, SAMPLES = 1024, 1 << 18
#: Words of up to so many bytes are merged in lock-step, so many at a time.
SHORT, ROWS = 64, 20_000
#: Bytes of ids that an encoding task gives at once.
OUT_BYTES = 4 << 20
#: Stands after each text; no code point.
END = 0x110000

# ---------------------------------------------------------------- pre-tokens

# Classes of characters.
OTHER, LETTER, NUMBER, SPACE, STOP = range(5)
# What may follow an apostrophe, by its length: the pattern's contractions.
CONTRACTIONS = {1: "stmd", 2: ["re", "ve", "ll"]}
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, and STOP for END."""
    if not _CLASSES:
        import regex

        table = np.zeros(END + 1, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, END)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, points):
                a, b = (p if p < 0xD800 else p + 0x800 for p in m.span())
                table[a:b] = kind
        table[END] = STOP
        _CLASSES.append(table)
    return _CLASSES[0]


def pretokens(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another, byte offsets of all pre-tokens (and the end), and each text's number of pre-tokens."""
    joined = b"".join(x for t in texts for x in (t.encode("utf-32-le", "surrogatepass"), b"\x00\x00\x11\x00"))
    cp = np.frombuffer(joined, np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(lengths + 1) - 1
    kind = classes()[np.minimum(cp, END)]
    n = len(cp)
    before = np.concatenate([[STOP], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [STOP]]).astype(np.uint8)
    space = kind == SPACE
    # A run of one class is one match, but white space: its last character goes to what follows if it is a blank, else it is a match of its own; at the end of a text all of the run is one match.
    start = kind != before
    last_space = space & (after != SPACE) & (after != STOP)
    blank = last_space & (cp == 0x20)
    start |= last_space
    follows = np.concatenate([[False], blank[:-1]])
    start &= ~follows
    # An apostrophe that starts a match takes a contraction with it.
    quotes = np.flatnonzero((cp == 0x27) & start)
    if len(quotes):
        padded = np.concatenate([cp, np.full(3, END, np.uint32)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        size = np.where(np.isin(one, list(map(ord, CONTRACTIONS[1]))), 2, 0)
        for a, b in CONTRACTIONS[2]:
            size = np.where((size == 0) & (one == ord(a)) & (two == ord(b)), 3, size)
        for q, s in zip(quotes[size > 0].tolist(), size[size > 0].tolist(), strict=True):
            start[q + 1 : q + s] = False
            if q + s < n and kind[q + s] != STOP:
                start[q + s] = True
    start &= kind != STOP
    at = np.flatnonzero(start)
    counts = np.diff(np.concatenate([[0], np.searchsorted(at, stops)]))
    width = ((cp >= 0x80).view(np.uint8) + (cp >= 0x800).view(np.uint8) + (cp >= 0x10000).view(np.uint8) + np.uint8(1)) * (kind != STOP).view(np.uint8)  # bytes of each character
    del joined, cp, kind, start
    ends = np.cumsum(width, dtype=np.int64 if len(width) > 1 << 28 else np.int32)
    offsets = np.concatenate([[0], ends])[at].astype(np.int64)
    data = b"".join(t.encode("utf-8", "surrogatepass") for t in texts)
    return data, np.append(offsets, len(data)), counts


def parts_of(text: str, most: int) -> Iterator[str]:
    """A long text in parts of about ``most`` characters with the same pre-tokens: cut at a blank between letters or digits, where one always starts."""
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while 0 < at < len(text) - 1 and not (text[at - 1].isalnum() and text[at + 1].isalnum()):
            at = text.find(" ", at + 1)
        if at < 0 or at == len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


# ---------------------------------------------------------------- words to ids


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_NONE = np.iinfo(np.int32).max


class Merger:
    """Ranks applied to single pre-tokens: the pair of tokens that make the token of least rank, the first of equal ones, becomes that token, until no pair makes one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes < 0).any():
            raise ValueError("a byte has no rank")
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes; a negative one is no token."""
        if not len(self.keys):
            return np.full(left.shape, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            own = self.ranks.get(word)
            if own is not None:
                out[i] = own.to_bytes(4, "little")
            else:
                groups.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, rows in groups.items():
            if width > SHORT:
                for i in rows:
                    out[i] = self._long(words[i])
            else:
                for a in range(0, len(rows), ROWS):
                    part = rows[a : a + ROWS]
                    for i, ids in zip(part, self._short([words[i] for i in part], width), strict=True):
                        out[i] = ids
        return out

    def _short(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        token = self._tokens(b"".join(w.ljust(width, b"\0") for w in words)).reshape(n, width)
        token[np.arange(width) >= size[:, None]] = -1
        rank = np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self._rank(token[:, :-1], token[:, 1:])
        done, left = np.empty((n, width), np.int32), np.empty(n, np.int64)
        alive, columns = np.arange(n), np.arange(width)
        while len(alive):
            at = rank.argmin(1)
            least = rank[np.arange(len(alive)), at]
            more = least != _NONE
            if not more.all():
                ended = ~more
                done[alive[ended]], left[alive[ended]] = token[ended], size[ended]
                alive, token, rank, size, at, least = alive[more], token[more], rank[more], size[more], at[more], least[more]
                if not len(alive):
                    break
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            token = np.take_along_axis(token, moved, 1)
            rank = np.take_along_axis(rank, moved, 1)
            size = size - 1
            token[columns >= size[:, None]] = -1
            rows = np.arange(len(alive))
            token[rows, at] = least
            after = np.minimum(at + 1, width - 1)
            rank[rows, at] = np.where(at + 1 < size, self._rank(least, token[rows, after]), _NONE)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(token[before, at[before] - 1], least[before])
            rank[:, -1] = _NONE
        return [row[:k].astype("<u4").tobytes() for row, k in zip(done, left.tolist(), strict=True)]

    def _tokens(self, data: bytes) -> np.ndarray:
        return self.bytes[np.frombuffer(data, np.uint8)]

    def _long(self, word: bytes) -> bytes:
        """One word by a heap of pairs over a linked list."""
        token: list[bytes | None] = [bytes([b]) for b in word]
        after, before = [*range(1, len(token)), -1], list(range(-1, len(token) - 1))
        pair = lambda i: self.ranks.get(token[i] + token[after[i]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(len(token)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if token[i] is None or pair(i) != r:
                continue
            gone = after[i]
            token[i], after[i] = token[i] + token[gone], after[gone]
            token[gone] = None
            if after[gone] >= 0:
                before[after[gone]] = i
            for j in (before[i], i):
                if j >= 0 and (new := pair(j)) is not None:
                    heapq.heappush(heap, (new, j))
        return np.array([self.ranks[t] for t in token if t is not None], "<u4").tobytes()


_MERGERS: dict[str, Merger] = {}


def merger(ranks: dict[bytes, int], name: str) -> Merger:
    """Made once a worker."""
    if name not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[name] = Merger(ranks)
    return _MERGERS[name]


def _pack(*values: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers, packed by byte planes: all low bytes first."""
    raw = [struct.pack("<I", len(v)) + v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in values]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at + 4).reshape(4, n).T.copy().view("<u4").ravel())
        at += 4 + 4 * n
    return out


def front_code(words: list[bytes]) -> bytes:
    """Sorted words, each as the length of what it shares with the one before (255 at most) and the rest, packed."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    shared = np.zeros(len(words), np.int64)
    most = np.minimum(size[1:], size[:-1])
    alive = np.flatnonzero(most > 0)
    for k in range(255):
        if not len(alive):
            break
        alive = alive[data[start[alive] + k] == data[start[alive + 1] + k]]
        shared[alive + 1] = k + 1
        alive = alive[most[alive] > k + 1]
    rest = []
    for a in range(0, len(words), ROWS):
        own = _spread(data, (start + shared)[a : a + ROWS], (size - shared)[a : a + ROWS])
        rest.append(own.tobytes())
    lengths = (size - shared).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([struct.pack("<I", len(words)), shared.astype(np.uint8).tobytes(), lengths, *rest]))


def front_decode(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    shared = raw[4 : 4 + n]
    lengths = np.frombuffer(raw, np.uint8, 4 * n, 4 + n).reshape(4, n).T.copy().view("<u4").ravel().tolist()
    at, word, out = 4 + 5 * n, b"", []
    for k, size in zip(shared, lengths, strict=True):
        word = word[:k] + raw[at : at + size]
        at += size
        out.append(word)
    return out


# ---------------------------------------------------------------- encoding

_LIST = T.ArrayType(T.BinaryType())
_BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("samples", _LIST), T.StructField("dictionary", T.BinaryType()), T.StructField("positions", _LIST), T.StructField("keys", _LIST)])


def code_positions(codes: np.ndarray, place: np.ndarray) -> bytes:
    """Pack ``place[codes]``, the sorted places of a block's words by position.

    Words that come once are marked in a bit plane, since their order says which
    is which; others are numbered by falling frequency.  Both lists of places go
    along.
    """
    count = np.bincount(codes, minlength=len(place))
    once = count[codes] == 1
    order = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
    number = np.zeros(len(place), np.int64)
    number[order] = np.arange(len(order))
    marks = np.packbits(np.concatenate([once, np.zeros(-len(once) % 32, bool)])).view("<u4")
    return _pack(np.array([len(codes)]), marks, number[codes[~once]], place[order], place[codes[once]])


def read_positions(blob: bytes) -> np.ndarray:
    (n,), marks, numbered, often, single = _unpack(blob)
    once = np.unpackbits(np.ascontiguousarray(marks).view(np.uint8), count=int(n)).astype(bool) if n else np.zeros(0, bool)
    out = np.empty(int(n), np.int64)
    out[once], out[~once] = single, often[numbered]
    return out


class _Block:
    """Segments with dictionaries of their own, which the block's takes in."""

    def __init__(self):
        self.words, self.codes, self.keys = [], [], []
        self.size = 0

    def add(self, words: list[pa.Array], counts: list[np.ndarray], keys: list[pa.RecordBatch], size: int) -> None:
        coded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
        self.words.append(coded.dictionary)
        self.codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32))
        rows = pa.Table.from_batches(keys).append_column("count", pa.array(np.concatenate(counts), pa.int64()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        self.keys.append(zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes()))
        self.size += size

    def row(self, number: int) -> pa.RecordBatch:
        every = pa.chunked_array(self.words, pa.large_binary()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_words = place[every.indices.to_numpy(zero_copy_only=False)]
        listed = every.dictionary.take(pa.array(order)).to_pylist()
        edges = np.cumsum([0, *map(len, self.words)])
        positions = [code_positions(codes, of_words[a:b]) for codes, a, b in zip(self.codes, edges, edges[1:], strict=False)]
        row = [number, [w[:SHORT] for w in listed if zlib.crc32(w) % EVERY == 0], front_code(listed), positions, self.keys]
        kinds = [pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=_BLOCKS.names)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its sampled words, its sorted dictionary, and for each segment its positions, and its rows and their numbers of pre-tokens as an Arrow stream."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    block = _Block()
    words, counts, keys, size = [], [], [], 0
    for batch in pieces(batches, "text", PIECE_BYTES):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        parts = [[p] for p in parts_of(texts[0], PIECE_BYTES)] if len(texts) == 1 else [texts]
        split = []
        for part in parts:
            data, offsets, own = pretokens(part)
            words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]))
            split.append(own)
            size += len(data)
        counts.append(np.sum(split, 0))
        keys.append(batch.select(["row"]))
        if size >= SEGMENT_BYTES:
            block.add(words, counts, keys, size)
            words, counts, keys, size = [], [], [], 0
        if block.size >= BLOCK_BYTES:
            yield block.row(number)
            block, number = _Block(), number + 1
    if keys:
        block.add(words, counts, keys, size)
    if block.keys:
        yield block.row(number)


def _dealer(splitters):
    """``splitters``: a broadcast of the sorted first words of all buckets but the first."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's words, packed by bucket."""
        from bisect import bisect_left

        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("dictionary"), strict=True):
                words = front_decode(blob.as_py())
                cuts = [0, *[bisect_left(words, s) for s in splitters.value], len(words)]
                parts = [(i, words[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([front_code(w) for _, w in parts], pa.binary())], names=["bucket", "block", "blob"])

    return deal


def _encoder(ranks):
    """``ranks``: a broadcast of a name and the ranks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists sorted by bucket to each block's ids in the order of its words; a bucket's distinct words are encoded once."""
        name, known = ranks.value
        merge = merger(known, name)
        bucket, seen = None, {}
        for batch in batches:
            out, first = [], 0
            for i, (own, blob) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True)):
                if own != bucket or len(seen) > CACHE_WORDS:
                    bucket, seen = own, {}
                words = front_decode(blob.as_py())
                new = [w for w in words if w not in seen]
                seen.update(zip(new, merge.encode(new), strict=True))
                found = [seen[w] for w in words]
                out.append(_pack(np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")))
                if sum(map(len, out)) >= OUT_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([part.column("block"), part.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "blob"])
                    out, first = [], i + 1
        del seen
        release()

    return encode


def _spread(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + size[i]] one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(starts - (ends - size), size)]


def _assembler(out: T.StructType, table):
    """``table``: a broadcast token-byte table, where ids are to be decoded again."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def assemble(key: tuple[pa.Scalar, ...], given: pa.Table) -> pa.Table:
        """One block: ids of its sorted words, spread by position and cut by row, a segment at a time."""
        types = to_arrow_schema(out)
        bucket = given.column("bucket").to_pylist()
        home = bucket.index(None)
        parts = sorted((b, i) for i, b in enumerate(bucket) if b is not None)
        unpacked = [_unpack(given.column("blob")[i].as_py()) for _, i in parts]
        size = np.concatenate([np.zeros(0, np.int64), *[u[0].astype(np.int64) for u in unpacked]])
        flat = np.concatenate([np.zeros(0, np.uint32), *[u[1] for u in unpacked]])
        starts = np.cumsum(size) - size
        found = []
        for positions, keys in zip(given.column("positions")[home], given.column("keys")[home], strict=True):
            places = read_positions(positions.as_py())
            own = size[places]
            ids = _spread(flat, starts[places], own).astype("<u4")
            with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(keys.as_py())) as stream:
                rows = stream.read_all()
            edges = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(rows.column("count").to_numpy())])]
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            columns = [rows.column("row").cast(types.field("row").type), pa.array(np.diff(edges), pa.int64()), packed]
            if table is not None:
                columns.append(pa.array([hashlib.sha256(d).hexdigest() for d in decode_values(packed, table.value)]))
            found.append(pa.table(columns, names=out.names))
        del flat, unpacked, packed, ids
        release()
        return pa.concat_tables(found)

    return assemble


def _splitters(blocks: DataFrame) -> list[bytes]:
    """The first words of all buckets but the first, from the sampled distinct words."""
    words = blocks.select(F.explode("samples").alias("w")).distinct()
    total = words.count()
    thin = 1 << max(0, math.ceil(math.log2(max(total, 1) / SAMPLES)))
    buckets = max(1, math.ceil(total * EVERY / BUCKET_WORDS))
    if buckets == 1:
        return []
    sample = sorted(bytes(r[0]) for r in words.where(F.pmod(F.xxhash64("w"), F.lit(thin)) == 0).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)})


def encode(docs: DataFrame, path: str, keys: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """row (the columns ``keys``), n_tokens and ids (little-endian unsigned 32-bit integers) of each row's whole text; ``path``: a tiktoken file of ranks.

    ``decoded``: also decoded_sha256, of the bytes that the ids give when they are decoded again in the same worker.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.struct("*").alias("_"))
    rows = given.select(F.struct(*[F.col("_")[k].alias(k) for k in keys]).alias("row"), F.col("_")[text].alias("text"))
    out = T.StructType([rows.schema["row"]]).add("n_tokens", T.LongType()).add("ids", T.BinaryType())
    out = out.add("decoded_sha256", T.StringType()) if decoded else out
    blocks = materialise(rows.mapInArrow(_to_blocks, _BLOCKS), "bpe-blocks")
    splitters, ranks = spark.sparkContext.broadcast(_splitters(blocks)), spark.sparkContext.broadcast((path, read_ranks(path)))
    words = blocks.select("block", "dictionary").mapInArrow(_dealer(splitters), "bucket int, block long, blob binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(ranks), "block long, bucket int, blob binary")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    homes = blocks.select("block", *none("int", "bucket"), *none("binary", "blob"), "positions", "keys")
    both = homes.unionByName(ids.select("block", "bucket", "blob", *none("array<binary>", "positions", "keys")))
    return both.groupBy("block").applyInArrow(_assembler(out, spark.sparkContext.broadcast(token_table(path)) if decoded else None), out)


# ---------------------------------------------------------------- decoding


def token_table(path: str) -> pa.Table:
    """(id, token), a row for each token of the vocabulary, in the order of the ids."""
    ranks = sorted((rank, token) for token, rank in read_ranks(path).items())
    return pa.table({"id": pa.array([r for r, _ in ranks], pa.int64()), "token": pa.array([t for _, t in ranks], pa.binary())})


def decode_values(ids: pa.Array, table: pa.Table) -> Iterator[bytes | None]:
    """Each value's ids joined with the token-byte table, and the tokens one after another."""
    key, tokens = table.column("id").combine_chunks().to_numpy(), table.column("token").combine_chunks()
    edges = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    body, starts, size = np.frombuffer(tokens.buffers()[2] or b"", np.uint8), edges[:-1], np.diff(edges)
    dense = len(key) > 0 and key[0] == 0 and key[-1] == len(key) - 1
    for one in ids:
        if not one.is_valid:
            yield None
            continue
        own = np.frombuffer(one.as_py(), "<u4").astype(np.int64)
        row = np.minimum(own if dense else np.searchsorted(key, own), max(len(key) - 1, 0))  # the row of the table with this id
        if len(own) and (not len(key) or (key[row] != own).any()):
            raise ValueError("an id is not in the vocabulary")
        yield b"".join(_spread(body, starts[row[a : a + PIECE_BYTES]], size[row[a : a + PIECE_BYTES]]).tobytes() for a in range(0, len(row), PIECE_BYTES))


def decoder(spark, path: str):
    """An Arrow function from ids to bytes, over the broadcast token-byte table."""
    sent = spark.sparkContext.broadcast(token_table(path))

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array(list(decode_values(ids, sent.value)), pa.binary())

    return decode

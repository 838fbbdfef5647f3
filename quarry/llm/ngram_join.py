"""N-gram Jaccard join: MinHash banding proposes pairs of documents, and full n-gram sets decide.

Words are the runs of letters, digits and non-ASCII characters of the text in
lower case; a document's set holds the hashes (64 bits) of all its ``N`` successive
words, or of all its words if it has fewer.

1. One pass over the texts gives each row a class (a 128-bit hash of its set; of
   its text, if it has no words), the set's size and ``bands`` band hashes of
   ``rows`` MinHash values each.  ``plan_bands`` picks both for the recall wanted
   at the threshold.  Copies are folded to one row a class before anything else.
2. Rows are shuffled by band hash; members of a bucket are tied to its smallest
   class by a star, so a bucket of n classes makes n - 1 edges and no pairs.
   Components of these edges bound where pairs can be.
3. Small components share packs; a large one is cut into blocks of at most
   ``BLOCK_CLASSES`` classes and ``BLOCK_GRAMS`` n-grams, and every two blocks meet in
   a task of their own; a component above ``COMPONENT_CLASSES`` is joined bucket by
   bucket instead, in the same way, and a pair counts in its first common band.
   Each task rebuilds the sets from the texts, takes the pairs with a common band
   and counts common n-grams exactly.  It returns a row for each class with links:
   how many documents it is linked to, and the root of its links in that task.
4. Components of the links are the groups.

Defined cases: rows without words are copies of rows with equal text and have no
other links; null text is an empty text; a null id is an id like others; repeated
rows are documents of their own; an empty table gives an empty result; materialised
steps that nothing reads any more are removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, materialise, pieces, release
from .graph import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Most MinHash values of a document.
PERMUTATIONS = 128
BLOCK_CLASSES, BLOCK_GRAMS, PACK_CLASSES = 512, 1_000_000, 256
#: Bytes of text whose n-grams are hashed together, and rows of a block whose pairs are.
TEXT_BYTES, PAIR_ROWS = 512 << 10, 128
COMPONENT_CLASSES = 32_768

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach ``recall`` at ``threshold`` within ``most`` values."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text or "") + 1
        if size >= TEXT_BYTES or i == len(texts) - 1:
            out += _gram_sets(held, n)
            held, size = [], 0
    return out


def _gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    parts = [(t or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES) for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    stops = np.cumsum([len(p) + 1 for p in parts])
    inside = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    first, last = edges[::2], edges[1::2]
    size = last - first
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    letters = data[inside].astype(np.uint64) + _U(1)
    begin = np.cumsum(size) - size
    power = np.concatenate([[_U(1)], np.cumprod(np.full(int(size.max()), _BASE, np.uint64))])
    word = _mix(np.add.reduceat(letters * power[np.arange(len(letters)) - np.repeat(begin, size)], begin) + size.astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(first, stops)])
    gram = word.copy()
    padded = np.concatenate([word, np.zeros(n, np.uint64)])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(word))
    for k in range(1, n):
        gram = gram * _STEP + np.where(at + k < ends, padded[k : k + len(word)], _U(0))
    gram = _mix(gram)
    return [np.unique(gram[a : max(a + 1, b - n + 1)]) if b > a else np.zeros(0, np.uint64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def class_of(grams: np.ndarray, text: str | None) -> bytes:
    """16 bytes that equal sets share."""
    if not len(grams):
        return hashlib.blake2b(b"text" + (text or "").encode("utf-8", "replace"), digest_size=16).digest()
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


class MinHasher:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(0, 1 << 31, (bands * rows, 1), dtype=np.uint32) << 1) | 1
        self.shift = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """The band hashes of one set that is not empty."""
        low = (grams >> _U(32)).astype(np.uint32)
        least = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(low), 2048):
            np.minimum(least, (self.factor * low[a : a + 2048] + self.shift).min(1), out=least)
        values = least.astype(np.uint64).reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = _mix(out * _STEP + values[:, r])
        return out.view(np.int64)


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def _signer(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for batch in pieces(batches, "_text", 2 << 20):
            texts = batch.column("_text").to_pylist()
            sets = gram_sets(texts)
            classes = [class_of(s, t) for s, t in zip(sets, texts, strict=True)]
            hashes = [hasher.signature(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_hash"), pa.array(classes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _list(hashes, pa.int64())], names=["_doc", "_hash", "class", "n", "bands"])

    return sign


# ---------------------------------------------------------------- pairs


def shared_bands(a: np.ndarray, b: np.ndarray, only: int | None) -> np.ndarray:
    """(len(a), len(b)): pairs with a common band hash; with ``only``, those whose first common band it is."""
    found = np.zeros((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        same = a[:, k][:, None] == b[:, k][None, :]
        if only is None:
            found |= same
        elif k < only:
            found |= same
        else:
            return same & ~found
    return found


def common_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A & B| of each pair of indices, exactly: pair by pair if they are few, else by matrix products over the n-grams that two sets hold at least."""
    if not len(left):
        return np.zeros(0, np.int64)
    used, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    rows, at_left = np.unique(where[: len(left)], return_inverse=True)
    others, at_right = np.unique(where[len(left) :], return_inverse=True)
    sizes = np.array([len(sets[i]) for i in used.tolist()])
    values, column = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True)
    often = np.bincount(column) > 1
    width = int(often.sum())
    if len(rows) * len(others) * width / 1e10 > len(left) * (1e-5 + 2e-8 * sizes.mean()):
        return np.array([_both(sets[i], sets[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(used)), sizes)
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    product = np.zeros((len(rows), len(others)), np.float32)
    step = max(256, (2 << 20) // len(used))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        dense = np.zeros((len(used), min(step, width - a)), np.float32)
        dense[row[lo:hi], column[lo:hi] - a] = 1
        product += dense[rows] @ dense[others].T  # whole numbers below 2 ** 24
    return np.rint(product[at_left, at_right]).astype(np.int64)


def _both(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray | None, only: int | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of linked pairs, within ``left`` or between ``left`` and ``right``, some rows of ``left`` at a time."""
    size = np.array([len(s) for s in sets], np.int64)
    other = left if right is None else right
    for a in range(0, len(left), PAIR_ROWS):
        rows = left[a : a + PAIR_ROWS]
        shared = shared_bands(bands[rows], bands[other], only)
        if right is None:
            shared &= rows[:, None] < other[None, :]
        i, j = np.nonzero(shared)
        i, j = rows[i], other[j]
        fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9  # smaller ones cannot reach it
        i, j = i[fit], j[fit]
        both = common_grams(sets, i, j)
        good = both >= threshold * (size[i] + size[j] - both) - 1e-9
        yield i[good], j[good]


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that links lead to, given that of the links before."""
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


_FOUND = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])


def _verifier(threshold: float):
    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links of one pair of blocks."""
        band, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        table = table.combine_chunks()
        sets = gram_sets(table.column("_text").to_pylist())
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(table.num_rows, -1)
        block = table.column("block").to_numpy()
        weight = table.column("size").to_numpy()
        left = np.flatnonzero(block == i)
        links, root = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
        for a, b in linked(sets, bands, left, None if i == j else np.flatnonzero(block == j), None if band < 0 else band, threshold):
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            root = _roots(root, a, b)
        del sets, bands
        release()
        rows = np.flatnonzero(links)
        root = root[rows]
        classes = table.column("class")
        return pa.table([classes.take(pa.array(rows)), pa.array(links[rows]), classes.take(pa.array(root))], names=_FOUND.names)

    return verify


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _hash (of the text), class_id, n_links, copy_of and keep for every row.

    copy_of: the smallest id of the rows with the same n-grams; class_id: the
    smallest id of all rows that links lead to; n_links: other rows with a
    similarity of at least ``threshold``; keep: the (id, hash) that stands for
    the group.
    """
    bound_batches(docs.sparkSession)
    bands, rows = plan_bands(threshold, recall)
    filled = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(filled).alias("_hash"), filled.alias("_text"))
    signed = T.StructType([*base.select("_doc", "_hash").schema.fields, T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    signs = materialise(base.mapInArrow(_signer(bands, rows), signed), "signatures")
    classes = materialise(signs.groupBy("class").agg(F.min(F.struct("_doc", "_hash")).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    # Buckets of two classes or more, each tied to its smallest class.
    placed = classes.select("class", "n", F.posexplode("bands").alias("band", "h"))
    buckets = placed.groupBy("band", "h").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams")).where("members > 1")
    members = materialise(placed.select("class", "band", "h").join(buckets, ["band", "h"]), "buckets")
    parts = materialise(components(members.select(F.col("class").alias("a"), F.col("leader").alias("b"))), "candidates")

    # Where each class's pairs are looked for.
    near = parts.join(classes, F.col("node") == F.col("class")).select("class", "component", "rep", "size", "n", "bands")
    sizes = parts.join(classes.select("class", "n"), F.col("node") == F.col("class")).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
    sizes = materialise(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")), "components")
    small = sizes.where("blocks = 1").agg(F.sum("members").alias("m"), F.sum("grams").alias("g")).first()
    packs = max(1, math.ceil((small.m or 0) / PACK_CLASSES), math.ceil((small.g or 0) / BLOCK_GRAMS))
    near = near.join(sizes, "component")
    in_block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block")
    pack = F.when(F.col("blocks") == 1, F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs)).cast("string"))).otherwise(F.concat(F.lit("c"), F.hex("component")))
    by_component = near.where(F.col("members") <= COMPONENT_CLASSES).select("class", "rep", "size", "bands", pack.alias("group"), F.lit(-1).alias("band"), "blocks", in_block)
    own = members.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")).select("class", F.col("band").alias("own_band"), "h", F.col("blocks").alias("own_blocks"))
    by_bucket = near.where(F.col("members") > COMPONENT_CLASSES).join(own, "class").select(
        "class", "rep", "size", "bands", F.concat_ws("-", F.lit("b"), "own_band", "h").alias("group"), F.col("own_band").alias("band"), F.col("own_blocks").alias("blocks"), F.pmod(F.xxhash64("class"), F.col("own_blocks")).cast("int").alias("block"),
    )
    work = by_component.unionByName(by_bucket)

    # Texts of the classes that are looked at: one row's each.
    wanted = parts.join(classes, F.col("node") == F.col("class")).select("class", F.col("rep._doc").alias("_want"), F.col("rep._hash").alias("_want_hash"))
    texts = base.join(wanted, F.col("_doc").eqNullSafe(F.col("_want")) & (F.col("_hash") == F.col("_want_hash"))).groupBy("class").agg(F.first("_text").alias("_text"))
    meets = work.join(texts, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("class", "size", "bands", "_text", "block", "group", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = materialise(meets.groupBy("group", "band", "i", "j").applyInArrow(_verifier(threshold), _FOUND), "links")
    for done in (members, parts, sizes):
        discard(done)

    groups = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    each = classes.select("class", "rep", "size").join(links, "class", "left").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    each = materialise(each, "linked")
    for done in (found, classes):
        discard(done)
    firsts = each.groupBy("component").agg(F.min("rep").alias("keep"))
    each = each.join(firsts, "component").select("class", "rep", "keep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return signs.select("_doc", "_hash", "class").join(each, "class").select("_doc", "_hash", F.col("keep._doc").alias("class_id"), "n_links", F.col("rep._doc").alias("copy_of"), "keep")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which one of each group stays: that with the smallest id.

    Of rows with that id, the one with the smallest hash of its text stays, and of
    rows with equal texts too the first by all columns as JSON.
    """
    found = similar(docs, threshold, doc_id=doc_id, text=text)
    key = found.groupBy("_doc", "_hash").agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    stays = F.col("keep._doc").eqNullSafe(F.col("_doc")) & (F.col("keep._hash") == F.col("_hash"))
    key = materialise(key.select(F.col("_doc").alias("_own"), F.col("_hash").alias("_own_hash"), stays.alias("stays"), (F.col("n") > 1).alias("often")).where(~F.col("stays") | F.col("often")), "decided")
    rows = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(F.coalesce(F.col("row")[text], F.lit(""))).alias("_hash"))
    own = F.col("row")[doc_id].eqNullSafe(F.col("_own")) & (F.col("_hash") == F.col("_own_hash"))
    single = rows.join(key.select("_own", "_own_hash"), own, "left_anti").select("row")
    repeated = key.where("stays AND often")
    if repeated.isEmpty():
        return single.select("row.*")
    same = rows.join(repeated, own).groupBy(F.col("row")[doc_id], "_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionByName(same.select("row")).select("row.*")

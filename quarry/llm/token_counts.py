"""Token counts by separator scan: end-of-document ids are searched in flat, unindexed token files, piece by piece, and boundaries are stitched across pieces with a prefix scan.

A token file is a run of unsigned little-endian ids of 2 or 4 bytes in which every
document ends with a separator; nothing in it or beside it says where.  ``read_flat``
reads files of any size by byte ranges, whatever bytes are in them.

1. Each piece of a range, some MB, is searched as one array for the separator's
   bytes at every place.
2. A prefix scan of the pieces' sizes gives each piece its offset in the file, so
   that places between two ids fall out; the bytes before a piece decide the id
   that two pieces share.  (A table of pieces needs their order alone, no offsets.)
3. A second prefix scan, of the numbers of separators and of the last one's place,
   gives the ordinals of the documents that end in a piece and where its first
   document began.  Ends less starts are the counts.

A scan has two levels, ``GROUP`` bytes of a file to a group and then groups, so a
file with a third of all bytes is no task's load.

``write_flat`` makes such files of documents, one for each input partition, with
Spark's text writer, whose line separator is the document separator.

Defined cases: two separators in a row end an empty document; ids after the last
separator are a document of its own with ``ended`` false; an empty file has no
documents; null data is empty; a file that is no whole number of ids raises; null
and empty texts are empty documents; ids of documents can be of any type; repeated
documents count each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.ranges import read_ranges

from .common import bound_batches, materialise, shared_dir

#: Bytes that are searched together, and bytes of a file in a group of the scan.
PIECE, GROUP = 4 << 20, 1 << 30
#: What readers of text take off the beginning of a file.
_MARK = b"\xef\xbb\xbf"


# ---------------------------------------------------------------- flat files


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """file, size (of the file), place (where it begins) and data of the pieces of flat files."""
    return read_ranges(spark, path, block=PIECE).select("file", "size", F.col("start").alias("place"), F.col("content").alias("data"))


def write_flat(ids: DataFrame, column: str, separator: int, path: str, width: int = 2) -> None:
    """A flat file for each partition of ``ids``, in its order: the bytes in ``column`` (null: none) and a separator for each row."""
    ends = separator.to_bytes(width, "little").decode("latin-1")
    ids.select(F.coalesce(F.col(column), F.lit(b"")).cast("string").alias("value")).write.format("text").option("lineSep", ends).option("encoding", "ISO-8859-1").save(path)


# ---------------------------------------------------------------- scan


def _searcher(separator: int, width: int, gap: bytes):
    wanted = np.frombuffer(separator.to_bytes(width, "little"), np.uint8)

    def found(key: tuple, seq: int, data: bytes) -> tuple:
        d = np.frombuffer(data, np.uint8)
        same = np.ones(max(len(d) - width + 1, 0), bool)
        for k in range(width):
            same &= d[k : k + len(same)] == wanted[k]
        return (*key, seq, len(data), np.flatnonzero(same).tolist(), data[: width - 1], data[-(width - 1) :])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size = None, 0, [], 0
        types = pa.schema([("file", pa.string()), ("size", pa.int64()), ("place", pa.int64()), ("seq", pa.int64()), ("bytes", pa.int64()), ("at", pa.list_(pa.int64())), ("head", pa.binary()), ("tail", pa.binary())])

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("file", "size", "place")), strict=True)
            for own, data in zip(keys, batch.column("data"), strict=True):
                if own != key or size >= PIECE:
                    if size:
                        out.append(found(key, seq, b"".join(held)))
                    seq = seq + 1 if own == key else 0
                    key, held, size = own, [], 0
                part = (data.as_py() or b"") + gap
                held.append(part)
                size += len(part)
            if out:
                yield rows(out)
        if size:
            yield rows([found(key, seq, b"".join(held))])

    return search


def search(chunks: DataFrame, separator: int, width: int = 2, lines: bool = False) -> DataFrame:
    """file, size, place, seq, bytes, at (where the separator's bytes are), head and tail (width - 1 bytes) of every piece; rows of ``chunks`` with one file and place must follow each other in a partition. ``lines``: newline bytes were between them."""
    schema = "file string, size long, place long, seq long, bytes long, at array<long>, head binary, tail binary"
    given = chunks.select(F.col("file").cast("string").alias("file"), F.col("size").cast("long").alias("size"), F.col("place").cast("long").alias("place"), F.col("data").cast("binary").alias("data"))
    return materialise(given.mapInArrow(_searcher(separator, width, b"\n" if lines else b""), schema), "separators")


def _before(rows: DataFrame, sums: list[str], last: list[str]) -> DataFrame:
    """With ``{c}_before``: what the sums, and the greatest of ``last``, are over all earlier pieces of the file; and ``{c}_file`` over all."""
    inside = Window.partitionBy("file", "group").orderBy("place", "seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    groups = rows.groupBy("file", "group").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in last])
    ahead = groups.select(
        "file", "group",
        *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_ahead") for c in sums], *[F.max(c).over(over).alias(f"{c}_ahead") for c in last],
        *[F.sum(c).over(whole).alias(f"{c}_file") for c in sums], *[F.max(c).over(whole).alias(f"{c}_file") for c in last],
    )
    within = rows.withColumns({**{f"{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}, **{f"{c}_in": F.max(c).over(inside) for c in last}})
    joined = within.join(ahead, ["file", "group"])
    joined = joined.withColumns({**{f"{c}_before": F.col(f"{c}_in") + F.col(f"{c}_ahead") for c in sums}, **{f"{c}_before": F.coalesce(f"{c}_in", f"{c}_ahead") for c in last}})
    return joined.drop(*[f"{c}_{x}" for c in [*sums, *last] for x in ("in", "ahead")])


def _right(data: Column, n: int) -> Column:
    return F.substring(data, -n, n)


def _joints(rows: DataFrame, width: int) -> DataFrame:
    """With ``prefix``: the width - 1 bytes before a piece, of the pieces before it in its group and of the group before."""
    inside = Window.partitionBy("file", "group").orderBy("place", "seq")
    none = F.lit(b"")
    earlier = F.concat(*[F.coalesce(F.lag("tail", k).over(inside), none) for k in range(width - 1, 0, -1)])
    within = rows.withColumn("earlier", earlier)
    ends = within.groupBy("file", "group").agg(F.max_by(_right(F.concat("earlier", "tail"), width - 1), F.struct("place", "seq")).alias("end"))
    before = ends.select("file", "group", F.coalesce(F.lag("end").over(Window.partitionBy("file").orderBy("group")), none).alias("end"))
    return within.join(before, ["file", "group"]).withColumn("prefix", _right(F.concat("end", "earlier"), width - 1)).drop("earlier", "end")


def count_tokens(pieces: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file, ordinal (from 0), start (id number in the file), n_tokens (without the separator) and ended of every document; ``pieces``: of ``search``."""
    wanted = F.lit(separator.to_bytes(width, "little"))
    placed = _joints(_before(pieces.withColumn("group", F.floor(F.col("place") / GROUP)), ["bytes"], []), width)
    lost = F.when(F.col("bytes_file") < F.col("size"), len(_MARK)).otherwise(0)  # the reader has taken a mark off
    sized = placed.withColumns({"offset": F.col("bytes_before") + lost, "prefix": F.when(lost > 0, _right(F.concat(F.lit(_MARK), "prefix"), width - 1)).otherwise(F.col("prefix")), "size": F.coalesce("size", "bytes_file")})
    whole = F.when(F.col("size") % width != 0, F.raise_error(F.concat(F.lit("no whole number of ids: "), "file"))).otherwise(F.col("size"))
    shared = (F.col("offset") % width).cast("int")
    crossing = F.concat(F.substring("prefix", -shared, shared), F.substring("head", F.lit(1), width - shared))
    first = F.when((shared > 0) & (shared + F.col("bytes") >= width) & (crossing == wanted), F.array(F.col("offset") - shared)).otherwise(F.expr("cast(array() AS array<bigint>)"))
    inner = F.filter(F.transform("at", lambda a: a + F.col("offset")), lambda a: a % width == 0)
    hits = sized.select("file", "group", "place", "seq", whole.alias("size"), F.concat(first, inner).alias("hits"))
    counted = _before(hits.withColumns({"n": F.size("hits").cast("long"), "last": F.array_max("hits")}), ["n"], ["last"])
    begin = F.concat(F.array(F.coalesce("last_before", F.lit(-width))), F.slice("hits", 1, F.greatest(F.size("hits") - 1, F.lit(0))))
    each = counted.where("n > 0").select("file", "n_before", F.posexplode(F.arrays_zip(begin.alias("a"), F.col("hits").alias("b"))).alias("k", "d"))
    ids = lambda c: (c / width).cast("long")
    docs = each.select("file", (F.col("n_before") + F.col("k")).alias("ordinal"), (ids(F.col("d.a")) + 1).alias("start"), (ids(F.col("d.b") - F.col("d.a")) - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    ends = counted.groupBy("file").agg(F.max("size").alias("size"), F.max("n_file").alias("ordinal"), (F.coalesce(F.max("last_file"), F.lit(-width)) + width).alias("at"))
    rest = ends.where("at < size").select("file", "ordinal", ids(F.col("at")).alias("start"), ids(F.col("size") - F.col("at")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(rest)


# ---------------------------------------------------------------- token files of documents


def _tokeniser(ranks, width: int):
    @F.arrow_udf(T.BinaryType())
    def tokens(text: pa.Array) -> pa.Array:
        import tiktoken
        from public_tokenizers import PATTERN

        coder = tiktoken.Encoding("files", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        return pa.array((np.array(coder.encode_ordinary(one.as_py() or ""), f"<u{width}").tobytes() for one in text), pa.binary())

    return tokens


def pack(docs: DataFrame, ranks: dict[bytes, int], separator: int, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """The folder of the documents' token files, a file for each partition of ``docs``, and their manifest: part, ordinal, doc_id.

    The manifest numbers the rows of a partition, so ``docs`` must have the same
    rows in its partitions when it is read again, as a table that is scanned has;
    materialise others first.
    """
    if separator in ranks.values() or separator >= 1 << 8 * width:
        raise ValueError("the separator must be an id that the vocabulary leaves free")
    spark = docs.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    given = docs.select(F.struct("*").alias("row"))
    write_flat(given.select(_tokeniser(spark.sparkContext.broadcast(ranks), width)(F.col("row")[text]).alias("ids")), "ids", separator, path, width)
    row = F.monotonically_increasing_id()
    manifest = given.select(F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), F.col("row")[doc_id].alias("doc_id"))
    return path, materialise(manifest, "manifest")


def count_by_document(packed: tuple[str, DataFrame], separator: int, width: int = 2) -> DataFrame:
    """doc_id, file (number), ordinal, start, n_tokens of every document of ``pack``; raises where files and manifest do not agree."""
    path, manifest = packed
    counts = count_tokens(search(read_flat(manifest.sparkSession, path), separator, width), separator, width)
    parted = counts.select(F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"), "ordinal", "start", "n_tokens", F.lit(True).alias("counted"))
    both = manifest.withColumn("listed", F.lit(True)).join(parted, ["part", "ordinal"], "full")
    sure = F.when(F.col("listed") & F.col("counted"), F.col("part")).otherwise(F.raise_error(F.lit("token files and manifest do not agree")).cast("long"))
    return both.select("doc_id", sure.alias("file"), "ordinal", "start", "n_tokens")

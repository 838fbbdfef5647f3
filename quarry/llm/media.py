"""Media columns: texts or samples stored as FLAC, and FLAC columns written as PCM blocks with seekable sample offsets.  See ``flac`` for the codec.

A stream is decoded, its checksums are verified, and its samples are cut into
blocks of ``block_samples``; block b begins at sample b * block_samples, so sample
s is in block s // block_samples and no index is needed to seek.  Digests and
features are read from the blocks, in the order of their sample offsets.

Columns are handled by Arrow functions in pieces of a few MB, so memory is
bounded by the longest single value and not by a batch.

Defined cases: null media have no blocks and null features; a stream that fails
its checks raises ``BadStream`` unless ``strict`` is off, when it counts as null;
a stream without samples has no blocks, and its feature's range is 0 to 0;
repeated rows are handled each; other columns, of any name, are not touched; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from . import flac
from .common import pieces

BLOCK = pa.struct([("block", pa.int32()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("pcm", pa.binary())])
PCM = pa.struct([("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("blocks", pa.list_(BLOCK))])
FEATURES = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
#: Values that are coded together hold about so many bytes.
PIECE = 1 << 21
BLOCK_SAMPLES = 4096


def _in_pieces(column: pa.Array, f) -> list:
    out: list = []
    for part in pieces(iter([pa.RecordBatch.from_arrays([column], ["v"])]), "v", PIECE):
        out += f(part.column(0).to_pylist())
    return out


@F.arrow_udf(T.BinaryType())
def to_flac(payload: pa.Array) -> pa.Array:
    """Bytes, as unsigned 8-bit samples, to FLAC streams."""
    return pa.array(_in_pieces(payload, flac.encode), pa.binary())


def padded(text: Column, unit: int = flac.BLOCK) -> Column:
    """The UTF-8 bytes of ``text`` (null: none) and blanks up to a positive multiple of ``unit``."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    blanks = F.when(size == 0, unit).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(data, F.repeat(F.lit(" "), blanks.cast("int")).cast("binary"))


def _cut(stream: bytes | None, one: tuple[flac.Stream, np.ndarray] | None, block_samples: int) -> dict | None:
    if one is None:
        return None
    info, samples = one
    starts = range(0, len(samples), block_samples)
    parts = [samples[a : a + block_samples] for a in starts]
    alike = {"sample_rate": info.rate, "channels": info.channels, "bits": info.bits}
    blocks = [{"block": b, "sample_offset": a, "n_samples": len(p), **alike, "pcm": flac.pcm_bytes(p, info.bits)} for b, (a, p) in enumerate(zip(starts, parts, strict=True))]
    return {"media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "blocks": blocks}


def to_pcm(media: Column, block_samples: int = BLOCK_SAMPLES, strict: bool = True) -> Column:
    """FLAC streams to struct(media_bytes, media_sha256, blocks); a block holds interleaved signed little-endian samples."""

    @F.arrow_udf(from_arrow_type(PCM))
    def cut(streams: pa.Array) -> pa.Array:
        return pa.array(_in_pieces(streams, lambda part: [_cut(s, one, block_samples) for s, one in zip(part, flac.decode(part, strict), strict=True)]), PCM)

    return cut(media)


def pcm_blocks(media: DataFrame, column: str, block_samples: int = BLOCK_SAMPLES, strict: bool = True) -> DataFrame:
    """A row for each PCM block: row (all columns of ``media`` but the stream), block, sample_offset, n_samples, sample_rate, channels, bits, pcm."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in media.columns if c != column]
    cut = media.select(F.struct(*others).alias("row") if others else F.lit(None).alias("row"), to_pcm(F.col(f"`{column}`"), block_samples, strict).alias("p"))
    return cut.select("row", F.explode("p.blocks").alias("b")).select("row", "b.*")


class Level:
    """Number, range, sum, power, zero crossings and travel of samples that come in parts."""

    def __init__(self):
        self.n = self.total = self.power = self.crossings = self.travel = 0
        self.low = self.high = self.last = None

    def add(self, part: np.ndarray) -> None:
        if not len(part):
            return
        x = part.astype(np.int64)
        joined = x if self.last is None else np.concatenate([[self.last], x])
        low, high = int(x.min()), int(x.max())
        self.low, self.high = (low, high) if self.last is None else (min(low, self.low), max(high, self.high))
        self.n += len(x)
        self.total += int(x.sum())
        self.power += int((x * x).sum()) if max(-low, high) < 1 << 24 else sum(v * v for v in x.tolist())
        self.crossings += int(np.count_nonzero((joined[1:] < 0) != (joined[:-1] < 0)))
        self.travel += int(np.abs(np.diff(joined)).sum())
        self.last = int(x[-1])

    def __str__(self) -> str:
        return f"n={self.n};min={self.low or 0};max={self.high or 0};sum={self.total};power={self.power};crossings={self.crossings};travel={self.travel}"


def _samples(pcm: bytes, channels: int, bits: int) -> np.ndarray:
    """The first channel of a block."""
    if 16 < bits <= 24:
        raw = np.frombuffer(pcm, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) - ((raw[:, 2] >> 7) << 24)
    else:
        x = np.frombuffer(pcm, "<i1" if bits <= 8 else "<i2" if bits <= 16 else "<i4")
    return x[::channels]


def describe(pcm: dict | None) -> dict | None:
    """The payload's digests and the first channel's level, from blocks; mono 8-bit samples stand for unsigned bytes."""
    if pcm is None:
        return None
    digest, size, tail, level = hashlib.sha256(), 0, b"", Level()
    for block in sorted(pcm["blocks"], key=lambda b: b["sample_offset"]):
        data, channels, bits = block["pcm"], block["channels"], block["bits"]
        level.add(_samples(data, channels, bits))
        if channels == 1 and bits == 8:
            data = (np.frombuffer(data, np.uint8) ^ 0x80).tobytes()
        digest.update(data)
        size, tail = size + len(data), (tail + data)[-16:]
    return {"payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "feature": str(level)}


@F.arrow_udf(from_arrow_type(FEATURES))
def pcm_features(pcm: pa.Array) -> pa.Array:
    """payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes) and feature of PCM in blocks, one value at a time."""
    return pa.array((describe(one.as_py()) for one in pcm), FEATURES)

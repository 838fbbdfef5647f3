"""The codec against a decoder written sample by sample here, round trips and broken streams."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import flac, media, queries


class Reader:
    def __init__(self, data):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def read(self, n):
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n):
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        q = 0
        while not self.read(1):
            q += 1
        return q


def plain_decode(stream, block=192):
    """Mono 8-bit streams of full blocks, one sample after another."""
    info = flac.metadata(stream)
    r, out = Reader(stream[info.frames :]), []
    while len(out) < info.samples:
        assert r.read(16) == 0xFFF8
        code = r.read(4)
        r.read(12)
        lead = r.read(8)
        for _ in range(0 if lead < 0x80 else bin(lead)[2:].index("0") - 1):
            r.read(8)
        size = block if code == 1 else r.read(8) + 1
        r.read(8)
        kind = r.read(8) >> 1
        if kind == 0:
            x = [r.signed(8)] * size
        elif kind == 1:
            x = [r.signed(8) for _ in range(size)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [r.signed(8) for _ in range(order)]
            if kind >= 32:
                precision, shift = r.read(4) + 1, r.signed(5)
                weights = [r.signed(precision) for _ in range(order)]
            else:
                weights, shift = flac.FIXED[order], 0
            assert r.read(6) == 0
            k = r.read(4)
            while len(x) < size:
                u = r.unary() << k | r.read(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(w * v for w, v in zip(weights, x[::-1], strict=False)) >> shift))
        out += x
        r.at += -r.at % 8 + 16
    return bytes(v + 128 for v in out)


def wave(n, seed=0):
    t = np.arange(n)
    return (128 + 90 * np.sin(t / 9) + np.random.default_rng(seed).normal(0, 2, n)).astype(np.uint8).tobytes()


PAYLOADS = [wave(192 * 40), b"a" * 192, bytes(range(192)), ("Words and words. " * 400).encode()[: 192 * 30], np.random.default_rng(1).integers(0, 256, 192 * 9, dtype=np.uint8).tobytes(), b"\xff\xf8\x10\x02" * 48 * 150]


def test_round_trip_and_independent_decoder():
    streams = flac.encode(PAYLOADS)
    for payload, stream, (info, pcm) in zip(PAYLOADS, streams, flac.decode(streams), strict=True):
        assert (pcm[:, 0].astype(int) + 128).astype(np.uint8).tobytes() == payload == plain_decode(stream)
        assert info.samples == len(payload)
    assert len(streams[0]) < 0.7 * len(PAYLOADS[0])  # Rice codes and predictors are in use


def test_odd_sizes_nulls_and_equal_values():
    odd = [b"", b"x", b"y" * 191, b"z" * 193, None, b"x"]
    streams = flac.encode(odd)
    assert streams[4] is None and streams[1] == streams[5]
    assert [None if d is None else (d[1][:, 0].astype(int) + 128).astype(np.uint8).tobytes() for d in flac.decode(streams)] == odd


def test_checks_find_every_flipped_byte():
    stream = flac.encode([wave(192 * 3)])[0]
    start = flac.metadata(stream).frames
    for at in [*range(start, len(stream), 7), 30]:
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(bad)])
        assert flac.decode([stream, bytes(bad)], strict=False)[1] is None
    for short in (b"", b"fLaC", stream[:40], stream[:-1]):
        with pytest.raises(flac.BadStream):
            flac.decode([short])


def test_seeking_decodes_only_near_frames():
    payload = wave(192 * 300)
    stream = flac.encode([payload])[0]
    assert len(flac.metadata(stream).points) == 5
    for sample in (0, 191, 192, 20_000, 192 * 300 - 1):
        first, x = flac.seek(stream, sample)
        assert first <= sample < first + len(x) and (x[:, 0].astype(int) + 128).astype(np.uint8).tobytes() == payload[first : first + len(x)]


def build(samples, bits, assignment, kinds, block):
    """A one-frame stream written bit by bit: stereo or mono, any sample size, escapes, partitions and wasted bits."""
    out = []
    put = lambda v, n: out.extend((v >> (n - 1 - i)) & 1 for i in range(n))
    put(0xFFF8, 16), put(7, 4), put(0, 4), put(assignment, 4), put(0, 3), put(0, 1), put(0, 8), put(block - 1, 16)
    head = np.packbits(np.array(out, np.uint8))
    put(int(flac._crc(head, np.array([0]), np.array([len(head)]), flac.CRC8, 8)[0]), 8)
    for c, (kind, width) in enumerate(kinds):
        x = samples[c]
        if kind == "escape":  # fixed order 1, two partitions: Rice2 and escape
            put(9 << 1, 8), put(int(x[0]) & ((1 << width) - 1), width), put(1, 2), put(1, 4)
            d = np.diff(x)
            put(3, 5)
            for v in d[: block // 2 - 1]:
                u = int(v) * 2 if v >= 0 else -int(v) * 2 - 1
                out.extend([0] * (u >> 3) + [1])
                put(u & 7, 3)
            put(31, 5), put(20, 5)
            for v in d[block // 2 - 1 :]:
                put(int(v) & ((1 << 20) - 1), 20)
        else:  # verbatim with two wasted bits
            put(1 << 1 | 1, 8), out.extend([0, 1])
            for v in x:
                put(int(v) >> 2 & ((1 << (width - 2)) - 1), width - 2)
    out.extend([0] * (-len(out) % 8))
    frame = np.packbits(np.array(out, np.uint8))
    crc = int(flac._crc(frame, np.array([0]), np.array([len(frame)]), flac.CRC16, 16)[0])
    channels = 2 if assignment >= 8 else assignment + 1
    info = np.array([block, block], ">u2").tobytes() + b"\0" * 6 + ((44100 << 44) | ((channels - 1) << 41) | ((bits - 1) << 36) | block).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC\x80\0\0\x22" + info + frame.tobytes() + crc.to_bytes(2, "big")


def test_stereo_wasted_bits_partitions_and_escapes():
    rng = np.random.default_rng(5)
    left, right = np.cumsum(rng.integers(-9, 9, 32)), rng.integers(-2000, 2000, 32) * 4
    for assignment, first, second in ((1, left, right), (8, left, left - right), (9, left - right, right), (10, (left + right) >> 1, left - right)):
        kinds = [("escape", 16 + (assignment == 9)), ("escape", 16 + (assignment in (8, 10)))]
        if assignment == 1:
            kinds[1] = ("verbatim", 16)
        _, pcm = flac.decode([build([first, second], 16, assignment, kinds, 32)])[0]
        assert (pcm[:, 0] == left).all() and (pcm[:, 1] == right).all(), assignment


def test_long_streams_with_variable_blocks_take_linear_time():
    """Sample numbers instead of frame numbers, so frames are chained one by one; false headers stand in the samples."""
    rng, frames, at = np.random.default_rng(3), [], 0
    for i in range(100_000):
        n = 16 + i % 2
        samples = rng.integers(0, 256, n, dtype=np.uint8)
        if i % 5_000 == 7:  # a header with the next number, right but for the CRC-16
            coded, count = flac._coded_number(np.array([at + n]))
            fake = bytes([0xFF, 0xF9, 0x60, 0x02, *coded[0, : count[0]].tolist(), 7])
            fake += bytes(flac._crc(np.frombuffer(fake, np.uint8), np.array([0]), np.array([len(fake)]), flac.CRC8, 8).astype(np.uint8))
            samples[: len(fake)] = np.frombuffer(fake, np.uint8)
        frame = bytearray(flac._short_frame(samples.tobytes(), at))
        frame[1] = 0xF9
        head = len(frame) - 2 - n - 1
        frame[head - 1] = int(flac._crc(np.frombuffer(bytes(frame), np.uint8), np.array([0]), np.array([head - 1]), flac.CRC8, 8)[0])
        frames.append((bytes(frame[:-2]), samples))
        at += n
    data = b"".join(f + b"\0\0" for f, _ in frames)
    size = np.array([len(f) for f, _ in frames])
    start = np.cumsum(size + 2) - size - 2
    crc = flac._crc(np.frombuffer(data, np.uint8), start, size, flac.CRC16, 16)
    body = b"".join(f + int(c).to_bytes(2, "big") for (f, _), c in zip(frames, crc, strict=True))
    info = np.array([16, 17], ">u2").tobytes() + b"\0" * 6 + ((8000 << 44) | (7 << 36) | at).to_bytes(8, "big") + b"\0" * 16
    began = time.perf_counter()
    _, pcm = flac.decode([b"fLaC\x80\0\0\x22" + info + body])[0]
    assert time.perf_counter() - began < 20
    assert (pcm[:, 0].view(np.uint8) == np.concatenate([x for _, x in frames])).all()


def feature_of(payload):
    """On the whole array."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};min={x.min()};max={x.max()};sum={x.sum()};power={(x * x).sum()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()};travel={abs(x[1:] - x[:-1]).sum()}"


def test_query_against_the_payloads(spark, tmp_path):
    texts = [(1, "hello world   "), (2, None), (3, ""), (4, "é" * 5_000), (4, "é" * 5_000), (None, "日本 " * 900), (5, "The end. " * 2_300_000), (6, "\x7f\x01" * 4_096)]
    spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, pcm int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op1_flac(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for d, text in texts:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        media_bytes = flac.encode([payload])[0]
        assert (flac.decode([media_bytes])[0][1][:, 0].astype(int) + 128).astype(np.uint8).tobytes() == payload
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), feature_of(payload)))
    assert got == sorted(want, key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_flac(spark, f"{tmp_path}/none").count() == 0


def test_column_operators(spark):
    stored = spark.createDataFrame([("a", "hello " * 5000, 1, 2)], "name string, text string, block int, pcm int").withColumn("m", media.to_flac(media.padded(F.col("text"))))
    blocks = media.pcm_blocks(stored, "m", block_samples=1000).orderBy("block").collect()
    joined = b"".join(bytes(b["pcm"]) for b in blocks)
    assert [b["sample_offset"] for b in blocks] == list(range(0, 30144, 1000)) and bytes((v + 128) % 256 for v in joined) == b"hello " * 5000 + b" " * 144
    assert blocks[0]["row"].asDict() == {"name": "a", "text": "hello " * 5000, "block": 1, "pcm": 2}
    bad = spark.createDataFrame([(None, 1), (b"junk", 1), (flac.encode([b""])[0], 2)], "m binary, k int")
    assert media.pcm_blocks(bad, "m", strict=False).count() == 0
    found = [r["f"] for r in bad.select(media.pcm_features(media.to_pcm(F.col("m"), strict=False)).alias("f")).collect()]
    assert found[:2] == [None, None] and (found[2]["payload_bytes"], found[2]["feature"]) == (0, "n=0;min=0;max=0;sum=0;power=0;crossings=0;travel=0")
    rng = np.random.default_rng(5)
    left, right = np.cumsum(rng.integers(-9, 9, 32)), rng.integers(-2000, 2000, 32) * 4
    stereo = spark.createDataFrame([(build([left, right], 16, 1, [("escape", 16), ("verbatim", 16)], 32),)], "m binary")
    one = stereo.select(media.pcm_features(media.to_pcm(F.col("m"), 10)).alias("f")).first()["f"]
    pcm = np.stack([left, right], 1).astype("<i2").tobytes()
    assert (one["payload_bytes"], one["payload_sha256"]) == (128, hashlib.sha256(pcm).hexdigest()) and f"min={left.min()};max={left.max()};" in one["feature"]

"""FLAC media columns: frames decoded from Rice residuals and linear predictors, checksums verified, PCM written in blocks with sample offsets.

All streams of an Arrow batch are taken together, and their frames in lock-step:
step i handles sample i of every frame in one NumPy operation, so the cost of
Python is a frame's length and not the number of samples.

The decoder reads constant, verbatim, fixed and LPC subframes, partitioned Rice
codes of both kinds with escapes, wasted bits, any block size, 4 to 32 bits a sample and up
to 8 channels with side coding.  It finds frames by their sync code and header
CRC-8, takes them in the order of their numbers and verifies each CRC-16, the
number of samples and the MD5 of the samples; a stream that fails raises
``BadStream`` or, with ``strict=False``, gives null.

The encoder writes mono 8-bit streams in blocks of 192 samples with constant,
verbatim, fixed (orders 0 to 2) or second-order LPC subframes, whichever is
shortest, and a seek table with a point every ``SEEK_FRAMES`` frames.

Defined cases: null media give null; an empty batch gives nothing; equal
payloads give equal streams; a payload that is no multiple of 192 ends in a
shorter verbatim frame; an empty payload is a stream without frames.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 192
RATE = 8000
SEEK_FRAMES = 64
#: Samples that are encoded or decoded together.
CHUNK = 1 << 21
#: Frames that are followed by their numbers before their checksums are looked at.
AHEAD = 4096

# Fixed values of the format: block sizes and sample sizes by their code in a frame header (0: reserved or elsewhere).
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
SAMPLE_BITS = [0, 8, 12, 0, 16, 20, 24, 32]
# The fixed predictors' weights for the samples before, latest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class BadStream(ValueError):
    """Not a FLAC stream, or one whose checks fail."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ polynomial, value << 1) & ((1 << bits) - 1)
    return value


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zeros of a 16-bit number.
_ZEROS = (16 - np.frexp(np.arange(1 << 16, dtype=np.float64))[1]).astype(np.int64)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Of each of many ranges of ``data``, byte by byte in lock-step."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    crc = np.zeros(len(at), np.int64)
    for j in range(int(left[0]) if len(at) else 0):
        alive = int(np.searchsorted(-left, -j, side="left"))  # the longer ones
        c = crc[:alive]
        byte = data[at[:alive] + j].astype(np.int64)
        crc[:alive] = (c << 8 & ((1 << bits) - 1)) ^ table[c >> (bits - 8) ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


# ---------------------------------------------------------------- encoder


def _coded_number(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8-like coding: bytes (n, 7) and how many of them count."""
    n = number.astype(np.int64)
    count = 1 + sum((n >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31))
    out = np.zeros((len(n), 7), np.int64)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE])
    for size in range(1, 8):
        rows = count == size
        if rows.any():
            m = n[rows]
            for j in range(size):
                part = m >> (6 * (size - 1 - j))
                out[rows, j] = part if size == 1 else (lead[size] | part if j == 0 else 0x80 | part & 0x3F)
    return out, count


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc2(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second-order predictor of each row, in 64ths."""
    f = x.astype(np.float32)
    r0, r1, r2 = ((f[:, : BLOCK - lag] * f[:, lag:]).sum(1, dtype=np.float64) for lag in (0, 1, 2))
    base = np.maximum(r0 * r0 - r1 * r1, 1.0)
    return tuple(np.clip(np.rint(64 * a / base), -128, 127).astype(np.int32) for a in (r1 * (r0 - r2), r2 * r0 - r1 * r1))


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of full blocks ``x`` (n, 192), and each frame's length."""
    n = len(x)
    x = x.astype(np.int32)
    a1, a2 = _lpc2(x)
    d1 = np.diff(x, axis=1)
    residuals = [x, d1, np.diff(d1, axis=1), x[:, 2:] - ((a1[:, None] * x[:, 1:-1] + a2[:, None] * x[:, :-2]) >> 6)]
    orders, extra = [0, 1, 2, 2], [0, 8, 16, 16 + 9 + 16]
    cost, zig = [], []
    for r, more in zip(residuals, extra, strict=True):
        u = _zigzag(r)
        zig.append(u)
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 9)
        cost.append(r.shape[1] * (k + 1 + mean / 2**k) + more + 18)
    best = np.argmin(np.stack(cost), 0)
    order = np.array(orders)[best]
    u = np.zeros((n, BLOCK), np.int32)  # residuals in place, none for the samples before
    for kind in range(4):
        rows = best == kind
        u[rows, orders[kind] :] = zig[kind][rows]
    bits = np.stack([(BLOCK - order) * (k + 1) + (u >> k).sum(1) for k in range(10)])
    k = np.argmin(bits, 0)
    total = bits[k, np.arange(n)] + np.array(extra)[best] + 18
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (total >= 8 * BLOCK + 8)
    rice, lpc = ~constant & ~verbatim, ~constant & ~verbatim & (best == 3)

    # Columns of codes: 13 of the header, the subframe's, warm-up, LPC, Rice parameters, 192 samples, padding, CRC-16.
    value, size = np.zeros((n, 13 + 1 + 2 + 4 + 1 + BLOCK + 2), np.int32), np.zeros((n, 13 + 1 + 2 + 4 + 1 + BLOCK + 2), np.int32)
    coded, count = _coded_number(number)
    head = np.zeros((n, 12), np.int64)
    head[:, :4] = [0xFF, 0xF8, 0x10, 0x02]
    head[:, 4:11] = coded
    value[:, :11], size[:, :4] = head[:, :11], 8
    size[:, 4:11] = np.where(np.arange(7)[None, :] < count[:, None], 8, 0)
    value[:, 11], size[:, 11] = _crc(head.astype(np.uint8).ravel(), np.arange(n) * 12, 4 + count, CRC8, 8), 8
    at = 13
    value[:, at] = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 | 1, 8 | order))) << 1
    size[:, at] = 8
    for j in range(2):
        value[:, at + 1 + j], size[:, at + 1 + j] = x[:, j] & 255, np.where(rice & (order > j), 8, 0)
    value[:, at + 3], size[:, at + 3] = 7, np.where(lpc, 4, 0)
    value[:, at + 4], size[:, at + 4] = 6, np.where(lpc, 5, 0)
    value[:, at + 5], size[:, at + 5] = a1 & 255, np.where(lpc, 8, 0)
    value[:, at + 6], size[:, at + 6] = a2 & 255, np.where(lpc, 8, 0)
    value[:, at + 7], size[:, at + 7] = k, np.where(rice, 10, 0)
    codes = slice(at + 8, at + 8 + BLOCK)
    kk = k[:, None].astype(np.int32)
    value[:, codes] = np.where(rice[:, None], (1 << kk) | (u & ((1 << kk) - 1)), x & 255)
    size[:, codes] = np.where(rice[:, None], (u >> kk) + 1 + kk, 8)
    size[:, codes] *= ~(rice[:, None] & (np.arange(BLOCK)[None, :] < order[:, None])) & ~(constant[:, None] & (np.arange(BLOCK)[None, :] > 0))
    used = size.sum(1)
    size[:, -2] = -used % 8
    size[:, -1] = 16
    value[:, -1] = 0
    length = (used + size[:, -2] + 16) // 8
    end = np.cumsum(size.ravel(), dtype=np.int64)
    out = np.zeros(int(end[-1]), np.uint8)
    value, size = value.ravel(), size.ravel()
    for b in range(10):
        rows = np.flatnonzero((value >> b & 1).astype(bool) & (size > b))
        out[end[rows] - 1 - b] = 1
    data = np.packbits(out)
    stop = np.cumsum(length)
    crc = _crc(data, stop - length, length - 2, CRC16, 16)
    data[stop - 2], data[stop - 1] = crc >> 8, crc & 255
    return data, length


def _short_frame(samples: bytes, number: int) -> bytes:
    """A verbatim frame of fewer than 192 samples."""
    coded, count = _coded_number(np.array([number]))
    head = bytes([0xFF, 0xF8, 0x60, 0x02, *coded[0, : count[0]].tolist(), len(samples) - 1])
    head += bytes(_crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), CRC8, 8).astype(np.uint8))
    body = head + b"\x02" + samples
    crc = int(_crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), CRC16, 16)[0])
    return body + crc.to_bytes(2, "big")


def encode(payloads: list[bytes | None]) -> list[bytes | None]:
    """A FLAC stream for each payload; its bytes are unsigned 8-bit samples, stored with 128 taken off."""
    out: list[bytes | None] = [None] * len(payloads)
    todo: list[int] = []
    held = 0
    for i, payload in enumerate(payloads):
        if payload is not None:
            todo.append(i)
            held += len(payload)
        if todo and (held >= CHUNK or i == len(payloads) - 1):
            for j, stream in zip(todo, _encode([payloads[j] for j in todo]), strict=True):
                out[j] = stream
            todo, held = [], 0
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    counts = np.array([len(p) // BLOCK for p in payloads])
    signed = [(np.frombuffer(p, np.uint8) ^ 0x80) for p in payloads]
    full = [s[: c * BLOCK] for s, c in zip(signed, counts, strict=True)]
    x = np.concatenate(full).view(np.int8).reshape(-1, BLOCK) if counts.sum() else np.zeros((0, BLOCK), np.int8)
    number = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts, lengths = [], []
    step = max(1, CHUNK // BLOCK)
    for a in range(0, len(x), step):  # a long payload is cut too
        data, length = _frames(x[a : a + step], number[a : a + step])
        parts.append(data.tobytes())
        lengths.append(length)
    body, length = b"".join(parts), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    stop = np.concatenate([[0], np.cumsum(length)])
    out, first = [], 0
    for s, c in zip(signed, counts.tolist(), strict=True):
        frames = body[stop[first] : stop[first + c]]
        own = length[first : first + c]
        starts = (stop[first : first + c] - stop[first]).tolist()
        tail = s[c * BLOCK :].tobytes()
        if tail:
            starts.append(len(frames))
            frames += _short_frame(tail, c)
        sizes = own.tolist() + ([len(frames) - starts[-1]] if tail else [])
        points = b"".join(struct.pack(">QQH", j * BLOCK, starts[j], min(BLOCK, len(s) - j * BLOCK)) for j in range(0, len(starts), SEEK_FRAMES))
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(s)).to_bytes(8, "big") + hashlib.md5(s.tobytes()).digest()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + frames)
        first += c
    return out


# ---------------------------------------------------------------- decoder


@dataclass
class Stream:
    """What a stream's metadata says; ``frames`` is the offset of the first frame."""

    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: list[tuple[int, int, int]]
    frames: int


def metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise BadStream("no fLaC marker")
    at, found, points = 4, None, []
    while True:
        if at + 4 > len(data):
            raise BadStream("metadata end early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if len(block) < size:
            raise BadStream("metadata end early")
        if kind == 0 and size >= 34:
            packed = int.from_bytes(block[10:18], "big")
            found = (struct.unpack(">H", block[2:4])[0], packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), block[18:34])
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block[: size // 18 * 18]) if p[0] != (1 << 64) - 1]
        at += 4 + size
        if last:
            break
    if found is None:
        raise BadStream("no STREAMINFO")
    return Stream(*found, points, at)


class _Bits:
    """Many readers of one buffer; ``at`` holds their bit positions."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 8,), dtype=">u8", buffer=padded, strides=(1,))
        self.last = len(padded) - 9

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, from the top."""
        return self.words[np.minimum(at >> 3, self.last)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, bits: int) -> np.ndarray:
        """Unsigned; moves ``at``."""
        if bits == 0:
            return np.zeros(len(at), np.int64)
        out = (self.window(at) >> np.uint64(64 - bits)).astype(np.int64)
        at += bits
        return out

    def signed(self, at: np.ndarray, bits: int) -> np.ndarray:
        v = self.read(at, bits)
        return v - ((v >> (bits - 1) & 1) << bits) if bits else v

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros up to the next one, which is passed too."""
        q = _ZEROS[(self.window(at) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(q == 16)
        while len(more):
            here = at[more] + q[more]
            if (here >> 3 > self.last).any():
                raise BadStream("a code has no end")
            z = _ZEROS[(self.window(here) >> np.uint64(48)).astype(np.int64)]
            q[more] += z
            more = more[z == 16]
        at += q + 1
        return q


def _headers(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of frame headers at ``at``; ``ok`` where the CRC-8 fits."""
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    get = lambda j: padded[at + j].astype(np.int64)
    size_code, rate_code = get(2) >> 4, get(2) & 15
    channels, bits_code = get(3) >> 4, get(3) >> 1 & 7
    lead = get(4)
    count = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead == 0xFE], [1, 0, 2, 3, 4, 5, 6, 7], 0)
    number = np.where(count == 1, lead, lead & ((1 << np.maximum(7 - count, 0)) - 1))
    for j in range(1, 7):
        number = np.where(count > j, number << 6 | get(4 + j) & 63, number)
    block, after = np.array(BLOCK_SIZES)[size_code], 4 + count
    block = np.where((size_code >= 2) & (size_code <= 5), 576 << np.maximum(size_code - 2, 0), block)
    block = np.where(size_code == 6, padded[at + after].astype(np.int64) + 1, np.where(size_code == 7, (padded[at + after].astype(np.int64) << 8 | padded[at + after + 1]) + 1, block))
    after = after + np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    ok = (count > 0) & (block > 0) & (rate_code < 15) & (channels < 11) & (get(3) & 1 == 0) & (bits_code != 3)
    ok &= _crc(padded, at, after, CRC8, 8) == padded[at + after]
    return {"ok": ok, "block": block, "variable": get(1) & 1, "channels": channels, "bits_code": bits_code, "number": number, "body": at + after + 1}


def _chain(data: np.ndarray, head: dict[str, np.ndarray], at: np.ndarray, end: int, samples: int) -> list[int]:
    """Frames of one stream among candidate headers, where these hold false ones: each next frame must have the next number and end the frame before with a good CRC-16.

    The nearest headers with the next numbers are followed ``AHEAD`` frames and checked in lock-step; where one fails, the farther ones with its number are tried.
    """
    number, block = head["number"].tolist(), head["block"].tolist()
    following = (head["number"] + np.where(head["variable"] != 0, head["block"], 1)).tolist()
    places: dict[int, list[int]] = {}
    for i, n in enumerate(number):
        places.setdefault(n, []).append(i)
    stops = np.append(at, end)

    def followers(i: int) -> Iterator[int]:
        listed = places.get(following[i], [])
        return itertools.chain(itertools.islice(listed, bisect.bisect_right(listed, i), None), [len(at)])

    def good(path: list[int]) -> np.ndarray:
        here = at[np.array(path[:-1], np.int64)]
        return _crc(data, here, stops[np.array(path[1:], np.int64)] - here, CRC16, 16) == 0

    chosen: list[int] = []
    done, i = 0, places[0][0] if 0 in places else len(at)
    while i < len(at) and (not samples or done < samples):
        path, total = [i], done
        while len(path) <= AHEAD and path[-1] < len(at) and (not samples or total < samples):
            total += block[path[-1]]
            after = next(followers(path[-1]))
            if after == len(at) and samples and total < samples:  # a false header leads nowhere
                break
            path.append(after)
        if len(path) == 1:
            raise BadStream("a frame is missing")
        fit = good(path)
        right = len(fit) if fit.all() else int(np.argmin(fit))
        chosen += path[:right]
        done += sum(block[j] for j in path[:right])
        i = path[right]
        if right < len(fit):
            other = next((j for j in itertools.islice(followers(i), 1, None) if good([i, j])[0]), None)
            if other is None:
                raise BadStream("no frame ends with a good CRC-16")
            chosen.append(i)
            done += block[i]
            i = other
    return chosen


def decode(streams: list[bytes | None], strict: bool = True) -> list[tuple[Stream, np.ndarray] | None]:
    """Metadata and samples (samples, channels) of each stream."""
    out: list[tuple[Stream, np.ndarray] | None] = [None] * len(streams)
    todo: list[int] = []
    held = 0
    for i, stream in enumerate(streams):
        if stream is not None:
            todo.append(i)
            held += len(stream)
        if todo and (held >= CHUNK or i == len(streams) - 1):
            try:
                found: list = _decode([streams[j] for j in todo])
            except (BadStream, IndexError) as bad:
                if strict:
                    raise BadStream(str(bad)) from bad
                found = []
                for j in todo:
                    try:
                        found += _decode([streams[j]])
                    except (BadStream, IndexError):
                        found.append(None)
            for j, f in zip(todo, found, strict=True):
                out[j] = f
            todo, held = [], 0
    return out


def _decode(streams: list[bytes]) -> list[tuple[Stream, np.ndarray]]:
    info = [metadata(s) for s in streams]
    bodies = [s[m.frames :] for s, m in zip(streams, info, strict=True)]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(b) for b in bodies])
    starts = ends - [len(b) for b in bodies]
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    head = _headers(data, at)
    at, head = at[head["ok"]], {k: v[head["ok"]] for k, v in head.items()}
    owner = np.searchsorted(ends, at, side="right")
    counts = np.bincount(owner, minlength=len(streams))
    firsts = np.cumsum(counts) - counts
    rank = np.arange(len(at)) - firsts[owner]
    good = np.bincount(owner, weights=head["number"] == rank, minlength=len(streams)) == counts
    totals = np.bincount(owner, weights=head["block"], minlength=len(streams)).astype(np.int64)
    wanted = np.array([m.samples for m in info])
    good &= (totals == wanted) & (np.bincount(owner, weights=head["variable"], minlength=len(streams)) == 0)
    keep = np.ones(len(at), bool)
    for i in np.flatnonzero(~good).tolist():  # rare: a false header, or sample numbers
        own = np.arange(firsts[i], firsts[i] + counts[i])
        keep[own] = False
        keep[own[_chain(data, {k: v[own] for k, v in head.items()}, at[own], int(ends[i]), int(wanted[i]))]] = True
    at, owner, head = at[keep], owner[keep], {k: v[keep] for k, v in head.items()}
    counts = np.bincount(owner, minlength=len(streams))
    has = counts > 0
    if (at[(np.cumsum(counts) - counts)[has]] != starts[has]).any():
        raise BadStream("bytes before the first frame")
    if (wanted[counts == 0] > 0).any():
        raise BadStream("no frames")
    stop = np.append(at[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stop[last] = ends[owner[last]]
    if _crc(data, at, stop - at, CRC16, 16).any():
        raise BadStream("a frame's CRC-16 is wrong")
    bits = np.array(SAMPLE_BITS)[head["bits_code"]]
    bits = np.where(bits == 0, np.array([m.bits for m in info])[owner], bits)
    channels = np.where(head["channels"] < 8, head["channels"] + 1, 2)
    reader = _Bits(data)
    blocks: list[np.ndarray | None] = [None] * len(at)
    kinds = np.stack([head["block"], bits, head["channels"]], 1)
    for kind in np.unique(kinds, axis=0) if len(kinds) else []:
        every = np.flatnonzero((kinds == kind).all(1))
        step = max(1, CHUNK // int(kind[0]))
        for a in range(0, len(every), step):  # a long stream in parts
            rows = every[a : a + step]
            samples = _subframes(reader, head["body"][rows] * 8, int(kind[0]), int(kind[1]), int(kind[2]), int(channels[rows[0]])).astype(np.int8 if kind[1] <= 8 else np.int32)
            for r, block in zip(rows.tolist(), samples, strict=True):
                blocks[r] = block
    out, first = [], 0
    for m, c in zip(info, counts.tolist(), strict=True):
        pcm = np.concatenate(blocks[first : first + c]) if c else np.zeros((0, m.channels), np.int8 if m.bits <= 8 else np.int32)
        if m.samples and len(pcm) != m.samples:
            raise BadStream("the number of samples is wrong")
        if any(m.md5) and hashlib.md5(pcm_bytes(pcm, m.bits)).digest() != m.md5:
            raise BadStream("the MD5 of the samples is wrong")
        out.append((m, pcm))
        first += c
    return out


def _subframes(reader: _Bits, at: np.ndarray, block: int, bits: int, assignment: int, channels: int) -> np.ndarray:
    """(frames, block, channels) of frames alike in block size, sample size and channels."""
    out = np.empty((len(at), block, channels), np.int64)
    for c in range(channels):
        side = (assignment in (8, 10) and c == 1) or (assignment == 9 and c == 0)
        kind = reader.read(at, 8)
        wasted = np.zeros(len(at), np.int64)
        rows = np.flatnonzero(kind & 1)
        if len(rows):
            here = at[rows]
            wasted[rows] = reader.unary(here) + 1
            at[rows] = here
        for one in np.unique(kind >> 1 << 8 | wasted).tolist():
            rows = np.flatnonzero((kind >> 1 << 8 | wasted) == one)
            here = at[rows]
            waste = one & 255
            out[rows, :, c] = _subframe(reader, here, one >> 8, block, bits + side - waste) << waste
            at[rows] = here
    if assignment == 8:
        out[..., 1] = out[..., 0] - out[..., 1]
    elif assignment == 9:
        out[..., 0] += out[..., 1]
    elif assignment == 10:
        mid, side = out[..., 0] << 1 | out[..., 1] & 1, out[..., 1].copy()
        out[..., 0], out[..., 1] = (mid + side) >> 1, (mid - side) >> 1
    return out.astype(np.int32)


def _subframe(reader: _Bits, at: np.ndarray, kind: int, block: int, bits: int) -> np.ndarray:
    """Subframes of one kind, in lock-step."""
    n = len(at)
    x = np.empty((block, n), np.int64)
    if kind == 0:
        x[:] = reader.signed(at, bits)
        return x.T
    if kind == 1:
        for i in range(block):
            x[i] = reader.signed(at, bits)
        return x.T
    if 8 <= kind <= 12:
        order = kind - 8
    elif kind >= 32:
        order = kind - 31
    else:
        raise BadStream("a reserved kind of subframe")
    if order > block:
        raise BadStream("a predictor longer than its block")
    for i in range(order):
        x[i] = reader.signed(at, bits)
    shift = np.zeros(n, np.int64)
    weights = np.repeat(np.array(FIXED[order] if kind < 32 else [0] * order, np.int64)[:, None], n, 1)
    if kind >= 32:
        precision = reader.read(at, 4) + 1
        if (precision == 16).any():
            raise BadStream("a reserved precision")
        shift = reader.signed(at, 5)
        if (shift < 0).any():
            raise BadStream("a negative shift")
        for p in np.unique(precision).tolist():
            rows = np.flatnonzero(precision == p)
            here = at[rows]
            for j in range(order):
                weights[j, rows] = reader.signed(here, p)
            at[rows] = here
    coding = reader.read(at, 6)
    for one in np.unique(coding).tolist():
        rows = np.flatnonzero(coding == one)
        here = at[rows]
        _residuals(reader, here, x, rows, order, one >> 4, one & 15, block)
        at[rows] = here
    for i in range(order, block):
        guess = np.zeros(n, np.int64)
        for j in range(order):
            guess += weights[j] * x[i - 1 - j]
        x[i] += guess >> shift
    return x.T


def _residuals(reader: _Bits, at: np.ndarray, x: np.ndarray, rows: np.ndarray, order: int, method: int, partitions: int, block: int) -> None:
    """Rice codes of frames alike in method and partition order, into x[order:, rows]."""
    if method > 1 or block >> partitions << partitions != block or (block >> partitions) < order:
        raise BadStream("a bad residual coding")
    width = 4 + method
    escape = (1 << width) - 1
    everyone = len(rows) == x.shape[1]
    i = order
    for p in range(1 << partitions):
        k = reader.read(at, width)
        raw = np.flatnonzero(k == escape)
        raw_bits = np.zeros(len(at), np.int64)
        if len(raw):
            here = at[raw]
            raw_bits[raw] = reader.read(here, 5)
            at[raw] = here
        coded = np.flatnonzero(k != escape) if len(raw) else None
        down = (np.uint64(64) - k.astype(np.uint64)) if coded is None else None
        some = k > 0
        stop = (block >> partitions) * (p + 1)
        for i in range(i, stop):
            if coded is None:
                q = reader.unary(at)
                low = np.where(some, reader.window(at) >> np.minimum(down, np.uint64(63)), 0).astype(np.int64)
                at += k
                v = q << k | low
                v = v >> 1 ^ -(v & 1)
            else:
                v = np.zeros(len(at), np.int64)
                here, kc = at[coded], k[coded]
                q = reader.unary(here)
                low = np.where(kc > 0, reader.window(here) >> np.minimum(np.uint64(64) - kc.astype(np.uint64), np.uint64(63)), 0).astype(np.int64)
                at[coded] = here + kc
                w = q << kc | low
                v[coded] = w >> 1 ^ -(w & 1)
                for size in np.unique(raw_bits[raw]).tolist():
                    own = raw[raw_bits[raw] == size]
                    here = at[own]
                    v[own] = reader.signed(here, size)
                    at[own] = here
            if everyone:
                x[i] = v
            else:
                x[i, rows] = v
        i = stop


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved signed little-endian samples of whole bytes."""
    if bits <= 8:
        return samples.astype("<i1").tobytes()
    if bits <= 16:
        return samples.astype("<i2").tobytes()
    if bits <= 24:
        return samples.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    return samples.astype("<i4").tobytes()


def seek(data: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The first sample's number and the samples of the frame that holds ``sample``, from the seek table's nearest point on; only these frames are decoded."""
    m = metadata(data)
    if not 0 <= sample < m.samples:
        raise BadStream("no such sample")
    from_sample, offset, _ = max([p for p in m.points if p[0] <= sample] or [(0, 0, 0)])
    stop = min([p for p in m.points if p[0] > sample], default=(m.samples, len(data) - m.frames, 0))
    part = np.frombuffer(data, np.uint8)[m.frames + offset : m.frames + stop[1]]
    at = np.flatnonzero((part[:-1] == 0xFF) & (part[1:] & 0xFE == 0xF8))
    head = _headers(part, at)
    number = int(head["number"][0])
    head["number"] = head["number"] - number  # numbered from the point on
    ok = head["ok"]
    at, head = at[ok], {k: v[ok] for k, v in head.items()}
    chain = _chain(part, head, at, len(part), stop[0] - from_sample)
    first = from_sample
    for i in chain:
        block = int(head["block"][i])
        if first <= sample < first + block:
            bits = SAMPLE_BITS[int(head["bits_code"][i])] or m.bits
            assignment = int(head["channels"][i])
            return first, _subframes(_Bits(part), head["body"][i : i + 1] * 8, block, bits, assignment, assignment + 1 if assignment < 8 else 2)[0]
        first += block
    raise BadStream("the seek table is wrong")

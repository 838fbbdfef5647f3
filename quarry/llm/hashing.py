"""64-bit hashes of many ranges of bytes at once: equal ranges have equal hashes wherever they stand."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Bytes whose hashes are taken together, and of a range that is hashed on its own.
SPAN, LONG = 1 << 20, 1 << 12
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers() -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            _POWERS.append(np.concatenate([[_U(1)], np.cumprod(np.full(SPAN + LONG, base, _U))]))
    return _POWERS


def range_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, span: int = SPAN) -> np.ndarray:
    """A hash of each range of bytes; the ranges are in order and do not overlap."""
    out = np.empty(len(first), _U)
    size = last - first
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= LONG)
    up, down = _powers()
    a = 0
    while a < len(short):
        start = int(first[short[a]])
        b = max(a + 1, int(np.searchsorted(last[short], start + span, side="right")))
        rows = short[a:b]
        part = data[start : int(last[rows[-1]])].astype(_U) + _U(1)
        sums = np.concatenate([[_U(0)], np.cumsum(part * up[: len(part)])])
        at = first[rows] - start
        out[rows] = mix((sums[last[rows] - start] - sums[at]) * down[at] + size[rows].astype(_U))
        a = b
    return out

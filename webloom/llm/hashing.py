"""Hashes of substrings of a byte array, many at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
ODD = np.uint64(_ODD)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


class Substrings:
    """64-bit hashes of the substrings of b: equal strings have equal hashes wherever they stand."""

    def __init__(self, b: np.ndarray):
        up, self.down = _power(len(b) + 1)
        self.total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * up[: len(b)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length at every place."""
        n = max(0, len(self.total) - length)
        h = (self.total[length:] - self.total[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h

"""Vectorised 64-bit hashes of byte ranges."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(9)
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base, made as far as the longest text so far."""

    def __init__(self, base: np.uint64):
        self.base, self.made = base, np.ones(1, np.uint64)

    def to(self, n: int) -> np.ndarray:
        if len(self.made) < n:
            x = np.full(max(n, 2 * len(self.made)), self.base, np.uint64)
            x[0] = 1
            self.made = np.cumprod(x)
        return self.made[:n]


class Hasher:
    """Hashes of any substrings of a byte array, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, which: int = 0):
        base = BASES[which]
        self.table, self.up, self.down = _BYTES[which], Powers(base), Powers(np.uint64(pow(int(base), -1, 2**64)))

    def load(self, b: np.ndarray) -> None:
        self.before = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.up.to(len(b)), out=self.before[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.before[end] - self.before[start]) * self.down.to(len(self.before))[start] + (end - start).astype(np.uint64))

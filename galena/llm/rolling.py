"""Hashes of all stretches of a text from one array of prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Polynomial hashes modulo 2**64 of the stretches of some bytes, mixed with their length."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _power("down", len(self.sums))[start]
        return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, size: int) -> np.ndarray:
        """Of all stretches of one size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self.sums[size:] - self.sums[:n]) * _power("down", n)
        return mixed(raw + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))

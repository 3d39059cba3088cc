"""Hashes of many substrings of a byte array at once, with numpy; the same value for the same bytes in every task.

A substring's hash is a polynomial over a fixed table of 64-bit numbers, modulo 2**64, passed through a finaliser.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_INVERSE = pow(_ODD, -1, 1 << 64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = 1 << int(n).bit_length()
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            a = np.full(m, base, _U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Substrings:
    """Hashes of [start, end) for arrays of starts and ends."""

    def __init__(self, data: np.ndarray, numbers: np.ndarray | None = None):
        """data: bytes, or any 64-bit numbers given as `numbers`."""
        x = _TABLE[data] if numbers is None else numbers
        up, self.down = _power(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(x * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

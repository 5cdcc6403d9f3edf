"""64-bit hashes of byte ranges from one prefix sum, in numpy.

hash(a, b) = sum over i in [a, b) of R[byte i] * B^(i - a) mod 2^64, mixed with
the length.  R is a table of random words and B a random odd number, so equal
ranges have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = int(_rng.integers(1 << 40, 1 << 62)) | 1
_B_INV = pow(_B, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_B, _B_INV)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p[:size]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Prefix sums of one buffer."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.inverse = _up_to(n + 1)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * _powers[0][:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, size: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of all windows of ``size`` bytes that start in [first, last)."""
        last = len(self.sums) - size if last is None else last
        return mix((self.sums[first + size : last + size] - self.sums[first:last]) * self.inverse[first:last])


class Table:
    """Hash table from 64-bit hashes to numbers from 0, by open addressing; grows as it fills."""

    def __init__(self, bits: int = 16):
        self.used = 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        at = self._slots(h)
        out, held = self.values[at], self.keys[at]
        todo = np.flatnonzero((held != h) & (out >= 0))
        out[(held != h) & (out < 0)] = -1
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            v, ok = self.values[at[todo]], self.keys[at[todo]] == h[todo]
            out[todo] = np.where(ok, v, -1)
            todo = todo[~ok & (v >= 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that are not in the table."""
        if 2 * (self.used + len(h)) > len(self.keys):
            full = self.values >= 0
            h, values = np.concatenate([self.keys[full], h]), np.concatenate([self.values[full], values])
            self._alloc(max(self.bits + 1, int(2 * len(h)).bit_length() + 1))
            self.used = 0
        self.used += len(h)
        at, todo = self._slots(h), np.arange(len(h))
        while len(todo):
            free = todo[self.values[at[todo]] < 0]
            place, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[place], self.values[place] = h[put], values[put]
            left = np.ones(len(h), bool)
            left[put] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & self.mask

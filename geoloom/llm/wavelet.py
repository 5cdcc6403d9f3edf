"""Wavelet matrix over token ids, in one compressed file.

Bit-planes run from the highest bit to the lowest; each plane holds the bits of
the sequence as the planes above have reordered it (zeros first, order kept).
Planes are stored in blocks of BLOCK bytes, each compressed on its own, with
the count of ones before every block, so access, rank, select, counting and
occurrence lookup decompress a few blocks a plane.

File: magic, u32 header length, JSON header (n, planes, zeros, ones before each
block, block ends), document table (int64 doc ids with a presence byte, int64
lengths), then the compressed blocks.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
BLOCK = 1 << 14
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(tokens: np.ndarray, doc_ids: list, lengths: np.ndarray, n_planes: int) -> bytes:
    """One file's bytes; tokens must be below 2^n_planes."""
    seq = tokens.astype(np.uint32 if n_planes > 16 else np.uint16)
    squeeze = zstandard.ZstdCompressor(level=1)
    zeros, ones, ends, blocks, at = [], [], [], [], 0
    for b in range(n_planes - 1, -1, -1):
        mask, counts, stops, total = seq.dtype.type(1 << b), [], [], 0
        for s in range(0, len(seq), 8 * BLOCK):
            packed = np.packbits((seq[s : s + 8 * BLOCK] & mask) != 0, bitorder="little")
            counts.append(total)
            total += int(_POP[packed].sum(dtype=np.int64))
            blocks.append(squeeze.compress(packed.tobytes()))
            at += len(blocks[-1])
            stops.append(at)
        zeros.append(len(seq) - total)
        ones.append(counts)
        ends.append(stops)
        if b:
            spare, z, o = np.empty_like(seq), 0, len(seq) - total
            for s in range(0, len(seq), 8 * BLOCK):
                part = seq[s : s + 8 * BLOCK]
                bit = (part & mask) != 0
                high, low = part[np.flatnonzero(bit)], part[np.flatnonzero(~bit)]
                spare[z : z + len(low)], spare[o : o + len(high)] = low, high
                z, o = z + len(low), o + len(high)
            seq = spare
    head = json.dumps({"n": len(tokens), "planes": n_planes, "docs": len(doc_ids), "zeros": zeros, "ones": ones, "ends": ends}).encode()
    present = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    return b"".join([MAGIC, np.uint32(len(head)).tobytes(), head, present.tobytes(), ids.tobytes(), np.asarray(lengths, np.int64).tobytes(), *blocks])


class WaveletMatrix:
    """Reader over one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int(np.frombuffer(data, np.uint32, 1, 8)[0])
        head = json.loads(data[12 : 12 + size])
        at, d = 12 + size, head["docs"]
        self.n, self.planes, self.zeros, self.ones, self.ends = head["n"], head["planes"], head["zeros"], head["ones"], head["ends"]
        present = np.frombuffer(data, np.uint8, d, at)
        ids = np.frombuffer(data, np.int64, d, at + d) if d else np.zeros(0, np.int64)
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present, strict=True)]
        self.lengths = np.frombuffer(data, np.int64, d, at + 9 * d) if d else np.zeros(0, np.int64)
        self._data, self._base = data, at + 17 * d
        self._open = zstandard.ZstdDecompressor()
        self._block = lru_cache(maxsize=64)(self._read_block)

    def _span(self, plane: int, k: int) -> tuple[int, int]:
        ends = self.ends[plane]
        start = ends[k - 1] if k else (self.ends[plane - 1][-1] if plane and self.ends[plane - 1] else 0)
        return self._base + start, self._base + ends[k]

    def _read_block(self, plane: int, k: int) -> np.ndarray:
        a, b = self._span(plane, k)
        return np.frombuffer(self._open.decompress(self._data[a:b], max_output_size=BLOCK), np.uint8)

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // (8 * BLOCK))[i // 8 % BLOCK]) >> (i % 8) & 1

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        if i <= 0:
            return 0
        k, r = divmod(i, 8 * BLOCK)
        if k == len(self.ones[plane]):
            return self.n - self.zeros[plane]
        block = self._block(plane, k)
        full, rest = divmod(r, 8)
        more = int(_POP[block[:full]].sum(dtype=np.int64))
        return self.ones[plane][k] + more + (int(_POP[block[full] & ((1 << rest) - 1)]) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            r = self._rank1(plane, mid + 1)
            if (r if bit else mid + 1 - r) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """Token i."""
        value = 0
        for p in range(self.planes):
            bit, r = self._bit(p, i), self._rank1(p, i)
            i = self.zeros[p] + r if bit else i - r
            value = value << 1 | bit
        return value

    def _path(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for p in range(self.planes):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            a, b = (self.zeros[p] + ra, self.zeros[p] + rb) if token >> (self.planes - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands among the first i tokens."""
        if token >> self.planes:
            return 0
        a, b = self._path(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence; IndexError beyond the last."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._path(token, 0)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens: planes are undone from the lowest to the highest."""
        dtype = np.uint32 if self.planes > 16 else np.uint16
        seq = np.zeros(self.n, dtype)
        for p in range(self.planes - 1, -1, -1):
            up, z, o, mask = np.empty(self.n, dtype), 0, self.zeros[p], dtype(1 << (self.planes - 1 - p))
            for k in range(len(self.ends[p])):
                part = up[8 * BLOCK * k : 8 * BLOCK * (k + 1)]
                bit = np.unpackbits(self._read_block(p, k), count=len(part), bitorder="little").view(bool)
                high, low = np.flatnonzero(bit), np.flatnonzero(~bit)
                part[low], part[high] = seq[z : z + len(low)], seq[o : o + len(high)] | mask
                z, o = z + len(low), o + len(high)
            seq = up
        return seq

"""Merge engine: a score-ordered agenda of adjacent symbol pairs.

The best pair is the one whose merged symbol has the lowest rank, the leftmost
at equal ranks.  Symbols are numbered in score order.  Short words run side by
side as rows of a matrix, one agenda step for all words at a time.  Words of
more than LONG symbols, and words in which symbols of equal score may compete,
run on a heap, so that a text without spaces stays n log n.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 48
NONE = np.int32(2**31 - 1)


class Pairs:
    """Hash table (left id, right id) -> merged id with open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray | None = None):
        """``rank``: of each symbol, ascending; without it symbols rank by number."""
        self.rank = None if rank is None else rank.tolist()
        self.bits = max(4, int(len(left) * 3 - 1).bit_length())
        self.shift = np.uint64(64 - self.bits)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            own, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[own], self.vals[own] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
        self.dict = {int(k): int(v) for k, v in zip(keys, merged, strict=True)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair is unknown; negative symbols never merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.vals[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def one(self, left: int, right: int) -> int:
        return self.dict.get((left << 32) | right, -1) if left >= 0 and right >= 0 else -1


def merge_long(sym: list[int], pairs: Pairs) -> list[int]:
    """Heap agenda over one word."""
    n = len(sym)
    sym, nxt, prv = list(sym), list(range(1, n + 1)), list(range(-1, n - 1))
    rank = pairs.rank or range(1 << 31)
    agenda = [(rank[m], i, m, sym[i], sym[i + 1]) for i in range(n - 1) if (m := pairs.one(sym[i], sym[i + 1])) >= 0]
    heapq.heapify(agenda)
    alive = [True] * n
    while agenda:
        _, i, m, a, b = heapq.heappop(agenda)
        j = nxt[i]
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j] = m, False
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (x := pairs.one(m, sym[k])) >= 0:
                heapq.heappush(agenda, (rank[x], i, x, m, sym[k]))
        p = prv[i]
        if p >= 0 and (x := pairs.one(sym[p], m)) >= 0:
            heapq.heappush(agenda, (rank[x], p, x, sym[p], m))
    return [s for s, ok in zip(sym, alive, strict=True) if ok]


def _merge_rows(sym: np.ndarray, lens: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """All rows of a padded matrix, one merge a row and step."""
    n, width = sym.shape
    m = np.full((n, width), NONE, np.int32)
    if width > 1:
        m[:, :-1] = pairs.get(sym[:, :-1].reshape(-1), sym[:, 1:].reshape(-1)).reshape(n, width - 1)
        m[np.arange(width)[None, :] >= (lens - 1)[:, None]] = NONE
    done_sym, done_len = sym.copy(), lens.copy()
    rows, cols = np.arange(n), np.arange(width - 1)
    while len(rows):
        j = m.argmin(1)
        best = m[np.arange(len(rows)), j]
        live = best != NONE
        if not live.all():
            out = rows[~live]
            done_sym[out], done_len[out] = sym[~live], lens[~live]
            rows, sym, lens, m, j, best = rows[live], sym[live], lens[live], m[live], j[live], best[live]
            if not len(rows):
                break
        k = np.arange(len(rows))
        sym[k, j] = best
        behind = cols[None, :] > j[:, None]
        sym[:, :-1] = np.where(behind, sym[:, 1:], sym[:, :-1])
        m[:, :-1] = np.where(behind, m[:, 1:], m[:, :-1])
        lens = lens - 1
        right = j + 1 < lens
        new = np.full(len(rows), NONE, np.int32)
        new[right] = pairs.get(sym[k[right], j[right]], sym[k[right], j[right] + 1])
        m[k, j] = new
        left = j > 0
        m[k[left], j[left] - 1] = pairs.get(sym[k[left], j[left] - 1], sym[k[left], j[left]])
        m[k, np.maximum(lens - 1, 0)] = NONE
    return done_sym, done_len


def merge_words(sym: np.ndarray, lens: np.ndarray, pairs: Pairs, on_heap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, counts) of words given as one flat array of symbols and their lengths."""
    on_heap = (lens > LONG) if on_heap is None else on_heap | (lens > LONG)
    n = len(lens)
    starts = np.cumsum(lens) - lens
    counts = lens.astype(np.int64).copy()
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for high in (4, 8, 12, 16, 24, 32, LONG):
        for block in np.array_split(w := np.flatnonzero((lens > low) & (lens <= high) & ~on_heap), max(1, len(w) * high // 400_000)):
            if len(block):
                at = np.minimum(starts[block][:, None] + np.arange(high), len(sym) - 1)
                s, k = _merge_rows(sym[at], lens[block], pairs)
                parts.append((block, s, k))
                counts[block] = k
        low = high
    longer = np.flatnonzero(on_heap)
    long_ids = {}
    for i in longer:
        long_ids[i] = merge_long(sym[starts[i] : starts[i] + lens[i]].tolist(), pairs)
        counts[i] = len(long_ids[i])
    dest = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()) if n else 0, np.int32)
    for block, s, k in parts:
        mask = np.arange(s.shape[1])[None, :] < k[:, None]
        out[(dest[block][:, None] + np.arange(s.shape[1]))[mask]] = s[mask]
    for i, ids in long_ids.items():
        out[dest[i] : dest[i] + len(ids)] = ids
    return out, counts

"""Sampled suffixes: positions that every long string selects by its own content."""

from __future__ import annotations

import numpy as np

from geoloom.llm.hashing import Prefix

SEED = 32
#: Windows of a text are worked on in runs of this many starts.
RUN = 1 << 20


def _minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    m, have = keys, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(keys) - width + 1], m[width - have :][: len(keys) - width + 1])
    return m


def select(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, Prefix]:
    """Positions, ascending, and the buffer's prefix sums.

    Every ``length`` bytes that lie in one text hold a selected SEED-byte
    string, the one of least hash (leftmost at equal hashes), and equal strings
    select the same place: any repeat of ``length`` bytes shows as a repeat
    of a selected seed with equal surroundings.
    """
    prefix = Prefix(raw)
    width = length - SEED + 1
    found = []
    n = len(raw) - length + 1  # window starts
    ends = offsets[1:]
    for s in range(0, max(n, 0), RUN):
        e = min(s + RUN, n)
        h = prefix.windows(SEED, s, e + width - 1)
        at = np.arange(len(h), dtype=np.uint64)
        best = _minimum((h & ~np.uint64((1 << 22) - 1)) | at, width) & np.uint64((1 << 22) - 1)
        starts = np.arange(s, e)
        row_end = ends[np.searchsorted(ends, starts, side="right")]
        ok = starts + length <= row_end
        pos = best[ok].astype(np.int64)
        if len(pos):
            found.append(pos[np.concatenate([[True], pos[1:] != pos[:-1]])] + s)
    pos = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pos, prefix

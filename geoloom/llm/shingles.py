"""Word shingles of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from geoloom.llm.hashing import Prefix, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, starts) of the words of texts in one buffer that starts at offset 0; A-Z lower-cased."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[raw]
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[offsets[1:][np.diff(offsets) > 0] - 1] = inside[offsets[1:][np.diff(offsets) > 0] - 1]
    ends = np.flatnonzero(stop) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Prefix(low).ranges(starts, ends), rows, starts


def sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each row's distinct shingles of ``size`` words in ascending order.

    A text with fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    n = len(offsets) - 1
    h, rows, _ = words(raw, offsets)
    if not len(h):
        return h, np.zeros(n, np.int64)
    per = np.bincount(rows, minlength=n)
    left = np.cumsum(per)[rows] - np.arange(len(h))  # words from here to the text's end
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    acc = np.zeros(len(h), np.uint64)
    for k in range(size):
        w = np.zeros(len(h), np.uint64)
        w[: len(h) - k] = h[k:]
        w[left <= k] = 0
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(k + 1))
    keep = (left >= size) | (first & (per[rows] < size))
    acc, rows = acc[keep], rows[keep]
    order = np.lexsort((acc, rows))
    acc, rows = acc[order], rows[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (rows[1:] != rows[:-1])
    return acc[new], np.bincount(rows[new], minlength=n)

"""Arrow string columns as flat byte buffers for numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that arrays of
#: several words a byte stay small whatever an Arrow batch holds.
SLICE_BYTES = 2 << 20


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) row ranges of about ``limit`` bytes; a longer text is alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len of every range, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)

"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are compared after lower-casing A-Z and squeezing white space.
Item-sized windows of a text are embedded by the CGK random walk, under which
the Hamming distance follows the edit distance; a window and an item of its
size band are candidates if any table of sampled coordinates agrees.  Each
band's number of tables is chosen when the index is built: items are edited at
random up to the limit and tables are added until the target recall is reached;
if MAX_TABLES do not reach it, fewer coordinates are sampled a table.
Candidates are verified by exact approximate matching (Myers' bit vectors)
of the item in the window's surroundings.

Embedding a window at every byte would cost thousands of steps a byte, so
windows are placed by a bound that no match within the limit k escapes.  An item
is cut into disjoint pieces of PIECE bytes; x0 of them stay whole under the
edits, x1 get one edit, the others two or more, so 2 * x0 + x1 is at least
2 * pieces - k, and the text places of these pieces are shifted against each
other by k bytes at most.  Pieces with at most one edit are found by hash: whole,
with one byte masked, with one byte of the text left out, or with one byte of
the piece left out.  A window is placed where the pieces of an item reach that
sum within a band of shifts, each piece counted once.  Items too short for
that bound are cut into more than k pieces, one of which stays whole.

A placed window names its item; if any table agrees the two are a candidate,
else they become one unless the bound excludes them on pieces cut half a piece
later as well.  So neither placing nor sampling loses a match; ``recall`` of the
index is the share of planted edits at the limit on which tables agree.

Items are held in blocks of BLOCK_BYTES, one pass over the texts a block, so
what is broadcast has a fixed bound whatever the benchmark's size.

Defined results: null and empty texts and items match nothing; an item shorter
than SEED bytes matches only exactly; rows with equal ids are reported
once with the smallest distance; a null doc or item id is reported as null.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrowbytes
from geoloom.llm.common import small_batches
from geoloom.llm.hashing import Table

SIMILARITY, RECALL = 0.8, 0.99
#: Shortest item that may match with edits, coordinates a table at most, tables a band at most, walks, steps looked at.
SEED, SAMPLE, MAX_TABLES, WALKS, SPAN = 16, 4, 512, 8, 192
#: Bytes of a piece that may have one edit, and shortest item that is cut into such pieces.
PIECE, CUT = 8, 32
#: Bytes of text looked at at once, edited copies of each item for choosing tables, items of a band used for it.
CHUNK, TRIALS, TRIED = 1 << 17, 4, 400
#: Bytes of items in one block, and windows embedded at once.
BLOCK_BYTES, EMBEDDED = 1 << 20, 4096

_LOW = bytes(range(9)) + b" " * 5 + bytes(range(14, 65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space squeezed to one space, per text."""
    low = np.frombuffer(raw.tobytes().translate(_LOW), np.uint8)
    space = low == 32
    drop = np.zeros(len(low), bool)
    np.logical_and(space[1:], space[:-1], out=drop[1:])
    starts = offsets[:-1][np.diff(offsets) > 0]
    drop[starts] = space[starts]
    gone = np.flatnonzero(drop)
    if not len(gone):
        return low, offsets
    return low[~drop], offsets - np.searchsorted(gone, offsets)


def walk(texts: np.ndarray, lens: np.ndarray, n_steps: int, seed: int) -> np.ndarray:
    """CGK embeddings [n_steps, n] of rows of a padded matrix with a spare column of zeros.

    The walk copies a byte and moves on or stays by a random bit of (step, byte).
    """
    move = np.random.default_rng(seed).integers(0, 2, (n_steps, 256), dtype=np.int64)
    n, width = texts.shape
    flat, at = texts.reshape(-1), np.arange(n) * width
    end, out = at + lens, np.empty((n_steps, n), np.uint8)
    for j in range(n_steps):
        b = flat.take(at, out=out[j], mode="clip")
        at += move[j].take(b)
        np.minimum(at, end, out=at)
    return out


def embed(strings: list[np.ndarray], n_steps: int, seed: int) -> np.ndarray:
    """CGK embeddings [n, n_steps] of byte strings."""
    return walk(*_padded(strings), n_steps, seed).T


def _padded(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(s) for s in strings], np.int64)
    out = np.zeros((len(strings), int(lens.max(initial=0)) + 1), np.uint8)
    for i, s in enumerate(strings):
        out[i, : len(s)] = s
    return out, lens


def distance(pattern: bytes, text: bytes) -> int:
    """Smallest edit distance of ``pattern`` to any part of ``text`` (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for c in text:
        x = eq.get(c, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | (full & ~(d0 | vp)), vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            best = min(best, score)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return best


@dataclass
class Band:
    """LSH tables of the items of one size band."""

    members: np.ndarray  # indexes into the items
    coords: np.ndarray  # [tables, samples], steps of the walk
    walks: np.ndarray  # walk of each table
    n_steps: int
    keys: np.ndarray  # [tables, items]
    recall: float  # share of planted edits at the limit on which tables agree

    def sampled(self, texts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """[tables, n] sampled coordinates, packed."""
        out = np.empty((len(self.walks), len(lens)), np.uint32)
        for w in np.unique(self.walks):
            t = np.flatnonzero(self.walks == w)
            out[t] = _packed(walk(texts, lens, self.n_steps, 1000 + int(w)), self.coords[t])
        return out


def _packed(walked: np.ndarray, coords: np.ndarray) -> np.ndarray:
    out = np.zeros((len(coords), walked.shape[1]), np.uint32)
    for k in range(coords.shape[1]):
        out = (out << np.uint32(8)) | walked[coords[:, k]]
    return out


@dataclass
class Keys:
    """Hash index from keys to pieces: ``table`` gives a key's number, whose pieces are first..first + count of ``owner``."""

    bits: int
    seen: np.ndarray
    table: Table
    first: np.ndarray
    count: np.ndarray
    owner: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the key, piece) of all hits."""
        slot = (keys * _SPREAD) >> np.uint64(64 - self.bits)
        pos = np.flatnonzero(self.seen[slot.view(np.int64)])
        number = self.table.get(keys[pos])
        known = number >= 0
        pos, number = pos[known], number[known]
        k = self.count[number]
        return np.repeat(pos, k), self.owner[arrowbytes.ragged(self.first[number], k)]


@dataclass
class Pieces:
    """Disjoint pieces of ``size`` bytes of some items."""

    size: int
    owner: np.ndarray  # index into the items
    at: np.ndarray
    value: np.ndarray
    whole: Keys
    masked: list[Keys]  # by the byte that is masked; empty for pieces that must stay whole
    shorter: Keys | None  # one byte left out
    longest: int


@dataclass
class Index:
    """LSH index of one block of items."""

    ids: list
    items: list[bytes]
    lens: np.ndarray
    limits: np.ndarray
    need: np.ndarray  # sum that places a window
    band: np.ndarray  # of each item, -1 for short ones
    place: np.ndarray  # of each item in its band
    bands: list[Band]
    pieces: list[Pieces]
    short: list[int]

    @property
    def recall(self) -> float:
        return min((b.recall for b in self.bands), default=1.0)


def _edited(r: np.random.Generator, s: np.ndarray, k: int) -> np.ndarray:
    b = bytearray(s.tobytes())
    for _ in range(k):
        kind, p = int(r.integers(3)), int(r.integers(len(b)))
        c = int(r.integers(97, 123))
        if kind == 0:
            b[p] = c
        elif kind == 1:
            b.insert(p, c)
        elif len(b) > 1:
            del b[p]
    return np.frombuffer(bytes(b), np.uint8)


def _band(members: np.ndarray, arrays: list[np.ndarray], limits: np.ndarray, recall: float, seed: int) -> Band:
    r = np.random.default_rng(seed)
    some = members if len(members) <= TRIED else r.permutation(members)[:TRIED]
    some = np.repeat(some, TRIALS)
    # sampled steps lie where the walk of the shortest item still reads bytes
    n_steps = max(SAMPLE, min(SPAN, 3 * min(len(arrays[i]) for i in members) // 2))
    # as many bytes of an item as a walk may read, with their share of the edits
    head = [arrays[i][: 2 * n_steps] for i in some]
    near = [_edited(r, h, -(-int(limits[i]) * len(h) // len(arrays[i]))) for h, i in zip(head, some, strict=True)]
    whole, near = _padded(head), _padded(near)
    a = [walk(*whole, n_steps, 1000 + w) for w in range(WALKS)]
    b = [walk(*near, n_steps, 1000 + w) for w in range(WALKS)]
    walks = np.arange(MAX_TABLES) % WALKS
    for sample in range(SAMPLE, 0, -1):
        coords = np.sort(r.integers(0, n_steps, (MAX_TABLES, sample)), axis=1)
        found = np.zeros(len(some), bool)
        for t in range(MAX_TABLES):
            found |= (a[walks[t]][coords[t]] == b[walks[t]][coords[t]]).all(0)
            if found.mean() >= recall and t + 1 >= WALKS:
                # steps beyond the last sampled coordinate are never looked at
                out = Band(members, coords[: t + 1], walks[: t + 1], int(coords[: t + 1].max()) + 1, np.zeros(0), float(found.mean()))
                keys = [out.sampled(*_padded([arrays[i][:n_steps] for i in members[x : x + EMBEDDED]])) for x in range(0, len(members), EMBEDDED)]
                out.keys = np.concatenate(keys, axis=1)
                return out
    raise ValueError(f"recall {recall} is out of reach: {MAX_TABLES} tables of one coordinate agree on {found.mean()}")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: _FIRST[i] keeps the first i bytes of a word.
_FIRST = [np.uint64((1 << 8 * i) - 1) for i in range(9)]


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, zeros after the end."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,)).copy()


def _left_out(word: np.ndarray, after: np.ndarray, i: int) -> np.ndarray:
    """The word with byte i left out, ``after`` being the word one byte later."""
    return after ^ ((word ^ after) & _FIRST[i])


def _keys(values: np.ndarray, owner: np.ndarray) -> Keys:
    order = np.argsort(values, kind="stable")
    known, first, count = np.unique(values[order], return_index=True, return_counts=True)
    bits = min(22, max(16, int(40 * len(known)).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[((known * _SPREAD) >> np.uint64(64 - bits)).view(np.int64)] = True
    table = Table()
    table.put(known, np.arange(len(known), dtype=np.int32))
    return Keys(bits, seen, table, first, count, owner[order].astype(np.int32))


def _pieces(size: int, members: np.ndarray, arrays: list[np.ndarray], edits: bool) -> Pieces:
    n = np.array([len(arrays[i]) // size for i in members])
    owner, at = np.repeat(members, n), arrowbytes.ragged(np.zeros(len(n), np.int64), n) * size
    value = np.concatenate([_words(arrays[i])[: c * size : size] for i, c in zip(members, n, strict=True)]) & _FIRST[size]
    number = np.arange(len(value))
    masked = [_keys(value & ~(_FIRST[i + 1] ^ _FIRST[i]), number) for i in range(size)] if edits else []
    shorter = _keys(np.concatenate([_left_out(value, value >> np.uint64(8), i) for i in range(size)]), np.tile(number, size)) if edits else None
    return Pieces(size, owner, at, value, _keys(value, number), masked, shorter, max(len(arrays[i]) for i in members))


def build(rows: list[tuple], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 5) -> Index | None:
    """Index of (id, text) rows; None without any item.  ``recall`` is the aim of the tables."""
    ids, items = [], []
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        s = normal(raw, np.array([0, len(raw)]))[0].tobytes().strip()
        if s:
            ids.append(i)
            items.append(s)
    if not items:
        return None
    arrays = [np.frombuffer(s, np.uint8) for s in items]
    lens = np.array([len(s) for s in items])
    limits = ((1 - similarity) * lens + 1e-9).astype(np.int64)  # 1 - 0.8 is a little under 0.2
    long = lens >= SEED
    level = np.where(long, np.log2(lens).astype(np.int64), -1)
    index = Index(ids, items, lens, limits, np.zeros(len(items), np.int64), np.full(len(items), -1), np.zeros(len(items), np.int64), [], [], np.flatnonzero(~long).tolist())
    for k, b in enumerate(np.unique(level[long])):
        members = np.flatnonzero(level == b)
        index.band[members], index.place[members] = k, np.arange(len(members))
        index.bands.append(_band(members, arrays, limits, recall, seed))
    for size, members in sorted(_sizes(lens, limits).items()):
        index.need[members] = (2 * (lens // size) if size == PIECE else lens // size)[members] - limits[members]
        index.pieces.append(_pieces(size, np.array(members), arrays, size == PIECE))
    return index


def _sizes(lens: np.ndarray, limits: np.ndarray) -> dict[int, list[int]]:
    """Items by the size of their pieces: PIECE, or else so small that more pieces than the limit fit (at most 7 bytes)."""
    out: dict[int, list[int]] = {}
    for i, (n, k) in enumerate(zip(lens.tolist(), limits.tolist(), strict=True)):
        if n >= SEED:
            out.setdefault(PIECE if n >= CUT and 2 * (n // PIECE) > k else max(1, min(PIECE - 1, n // (k + 1))), []).append(i)
    return out


def _hits(p: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every piece that stands in ``text``; whole ones twice where one edit is allowed, so that hits add up to the bound's sum."""
    if len(text) < p.size - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    word = _words(text)[: len(text) - p.size + 2]
    found = [p.whole.find(word[: len(text) - p.size + 1] & _FIRST[p.size])]
    if p.masked:
        found.append(found[0])
        after = np.append(word[1:], np.uint64(0))
        for i, keys in enumerate(p.masked):
            pos, piece = keys.find(word & ~(_FIRST[i + 1] ^ _FIRST[i]))
            other = word[pos] != p.value[piece]
            found.append((pos[other], piece[other]))
        for i in range(1, p.size):
            found.append(p.whole.find(_left_out(word, after, i)))
        found.append(p.shorter.find(word & _FIRST[p.size - 1]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _windows(index: Index, text: np.ndarray) -> np.ndarray:
    """Rows (item, start, least and largest shift, a position inside) where an item's pieces reach its sum in a band of shifts."""
    found = []
    for p in index.pieces:
        more = 2 * p.longest
        step = max(CHUNK, more)
        each = p.longest // p.size + 1
        for a in range(0, len(text), step):
            pos, piece = _hits(p, text[a : a + step + more])
            if not len(pos):
                continue
            item, at = p.owner[piece], p.at[piece]
            shift = pos - at + 2 * more
            key = shift // (index.limits[item] + 1)
            # any two shifts within the limit share a bucket of key // 2 or of (key + 1) // 2
            low = item * (step + 4 * more)
            bits = np.uint64(64 - max(12, int(4 * len(pos)).bit_length()))
            for bucket in (low + (key >> 1), low + ((key + 1) >> 1)):
                # a cheap count that may only be too high, then each piece once: 2 if whole, else 1
                slot = ((bucket.view(np.uint64) * _SPREAD) >> bits).view(np.int64)
                keep = np.flatnonzero(np.bincount(slot)[slot] >= index.need[item])
                if not len(keep):
                    continue
                order = keep[np.lexsort((pos[keep], at[keep], bucket[keep]))]
                b, part, place = bucket[order], at[order] // p.size, pos[order]
                new = np.diff(b * each + part, prepend=-1) != 0
                twice = np.append((np.diff(place) == 0) & ~new[1:], False) if p.masked else np.zeros(len(order), bool)
                group = np.cumsum(np.diff(b, prepend=-1) != 0) - 1
                total = np.bincount(group[new])
                total += np.bincount(group[new], np.logical_or.reduceat(twice, np.flatnonzero(new))).astype(np.int64)
                first = np.flatnonzero(np.diff(b, prepend=-1))
                s = shift[order] - 2 * more + a
                good = np.flatnonzero(total >= index.need[item[order[first]]])
                found.append(np.stack([item[order[first]], s[first], np.minimum.reduceat(s, first), np.maximum.reduceat(s, first), place[first] + a])[:, good])
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((5, 0), np.int64)


def _agreed(index: Index, text: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether any table agrees on a window and its item."""
    out = np.zeros(len(item), bool)
    for k, band in enumerate(index.bands):
        mine = np.flatnonzero(index.band[item] == k)
        for x in range(0, len(mine), EMBEDDED):
            w = mine[x : x + EMBEDDED]
            lens = np.minimum(high[w] - low[w], band.n_steps)  # a walk reads a byte a step at most
            width = int(lens.max()) + 1
            at = low[w][:, None] + np.arange(width)
            cut = np.where(np.arange(width) < lens[:, None], text[np.minimum(at, len(text) - 1)], 0).astype(np.uint8)
            out[w] = (band.sampled(cut, lens) == band.keys[:, index.place[item[w]]]).any(0)
    return out


def _in_order(at: list[int], pos: list[int]) -> int:
    """Most pieces that stand in order: rising offsets ``at`` at rising positions."""
    tails: list[int] = []
    for _, p in sorted(zip(at, (-p for p in pos), strict=True)):
        k = bisect_left(tails, -p)
        tails[k : k + 1] = [-p]
    return len(tails)


def _excluded(item: bytes, text: bytes, limit: int) -> bool:
    """Whether too few pieces of ``item``, cut two bytes in, stand in order in ``text``."""
    need = (len(item) - 2) // PIECE - limit
    if need < 1:
        return False
    at, pos = [], []
    for a in range(2, len(item) - PIECE + 1, PIECE):
        piece = item[a : a + PIECE]
        p = text.find(piece)
        while p >= 0:
            at.append(a)
            pos.append(p)
            p = text.find(piece, p + 1)
    return len(set(at)) < need or _in_order(at, pos) < need


def _search(index: Index, text: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], int]:
    """(row, item) -> edit distance, within the item's limit."""
    best: dict[tuple[int, int], int] = {}
    around: dict[tuple[int, int], list[tuple[int, int]]] = {}
    item, start, least, most, inside = _windows(index, text)
    row = np.searchsorted(off, inside, side="right") - 1
    first, last, n, lim = off[row], off[row + 1], index.lens[item], index.limits[item]
    agreed = _agreed(index, text, item, np.maximum(start, first), np.minimum(np.maximum(start, first) + n, last))
    low, high = np.maximum(least - lim, first), np.minimum(most + n + lim, last)
    for r, i, x, y, sure in sorted(zip(row.tolist(), item.tolist(), low.tolist(), high.tolist(), agreed.tolist(), strict=True)):
        if y - x < len(index.items[i]) - index.limits[i] or not sure and _excluded(index.items[i], text[x:y].tobytes(), int(index.limits[i])):
            continue
        spans = around.setdefault((r, i), [])
        if spans and x <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
        else:
            spans.append((x, y))
    for (r, i), spans in around.items():
        for x, y in spans:
            d = distance(index.items[i], text[x:y].tobytes())
            if d <= index.limits[i] and d < best.get((r, i), 1 << 60):
                best[r, i] = d
    whole = text.tobytes() if index.short else b""
    for i in index.short:
        item = index.items[i]
        at = whole.find(item)
        while at >= 0:
            r = int(np.searchsorted(off, at, side="right")) - 1
            if at + len(item) <= off[r + 1]:
                best[r, i] = 0
            at = whole.find(item, at + 1)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance: items found in documents, each pair once with the smallest distance."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k)
        index = build([(r.i, r.t) for r in block.orderBy("i", "t").collect()], similarity)
        if index is None:
            continue
        found = _pass(texts, index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _pass(texts: DataFrame, index: Index) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = held.value
        for b in batches:
            raw, off = arrowbytes.flat(b.column(1))
            ids = b.column(0)
            for x, y in arrowbytes.slices(off):
                t, o = normal(raw[off[x] : off[y]], off[x : y + 1] - off[x])
                best = _search(index, t, o)
                if best:
                    rows = [(ids[x + r].as_py(), index.ids[i], d) for (r, i), d in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array([q[k] for q in rows], ty) for k, ty in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "distance"])

    return texts.mapInArrow(run, "doc_id long, item_id long, distance int")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` in which no item was found."""
    bad = leaks(docs, benchmark, similarity, doc_id).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad.bad_id), "left_anti")

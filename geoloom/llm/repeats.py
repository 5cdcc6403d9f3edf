"""Removal of long repeated byte strings by a logarithmic index family.

A byte goes if some string of ``length`` bytes that covers it also starts at
another place of the corpus.  Full suffix arrays of a corpus are many times its
size, so the index holds sampled suffixes (``anchors``): every string of
``length`` bytes selects one SEED-byte seed by its own content, so two equal
strings meet at equal seeds with equal surroundings.

1. Each text yields its seeds: hash of the seed, hash of its surroundings (all
   that any string selecting it can reach), place.
2. Seeds are dealt by hash to index shards.  A shard takes its rows in batches:
   a batch is sorted into a suffix array of its own, merge-scanned against the
   existing levels, what is new becomes a level, and levels of equal size class
   merge, so that there are logarithmically many.  Surroundings seen twice are
   covered as a whole.  Seeds that repeat with other surroundings stand at the
   edge of a match.
3. The surroundings of edge seeds, one for each distinct kind, are cut from the
   texts and meet by seed; there every window is compared exactly at its place
   beside the seed.
4. Covered runs are joined to the texts and cut out.

A seed with many different surroundings in one slice of input is marked hot: its
rows are dealt by seed and surroundings, and its edges by parts of the
surroundings, so no such group is gathered in one task.

Strings are compared by 64-bit hashes, of the surroundings and of windows.

Defined results: null and empty texts have no bytes and nothing removed; rows
with equal id and text repeat each other; matches never cross rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import anchors, arrowbytes
from geoloom.llm.anchors import SEED
from geoloom.llm.common import materialize, small_batches
from geoloom.llm.hashing import Prefix, mix

LENGTH = 200
#: Distinct surroundings of one seed in a slice from which it counts as hot, and
#: the shards it is then dealt to.
HOT, SALT = 16, 64
#: Kinds of surroundings in a shard from which a seed is hot as well.
MANY = 4096
#: Parts of the surroundings by which a hot seed's edges are dealt.
PARTS = 8
#: Stored bytes of texts whose seeds make one shard (a seed in 69 bytes of text, about 100 bytes a seed in memory), and shards at most.
SHARD_BYTES, MAX_SHARDS = 64 << 20, 100_000
#: Rows of edge surroundings that are compared at once.
CHUNK = 4_000
COVER, EDGE, SOURCE = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seeds(raw: np.ndarray, off: np.ndarray, length: int):
    """row, pos, lo, hi, seed hash, surroundings hash of one slice's seeds."""
    pos, prefix = anchors.select(raw, off, length)
    row = np.searchsorted(off, pos, side="right") - 1
    lo, hi = np.maximum(pos - (length - SEED), off[row]), np.minimum(pos + length, off[row + 1])
    kh = prefix.ranges(pos, pos + SEED)
    around = mix(prefix.ranges(lo, hi) + (pos - lo).astype(np.uint64) * _ODD)
    return row, pos, lo, hi, kh, around


def seeds(texts: DataFrame, length: int) -> DataFrame:
    """texts (doc_id, h, text) -> index rows.

    Surroundings that occur twice in a slice are covered there and then; one of
    them goes on to the index with a count of two.
    """

    def run(batches):
        for b in batches:
            raw, offsets = arrowbytes.flat(b.column(2))
            ids, hs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for x, y in arrowbytes.slices(offsets):
                off = offsets[x : y + 1] - offsets[x]
                row, pos, lo, hi, kh, around = _seeds(raw[offsets[x] : offsets[y]], off, length)
                if not len(pos):
                    continue
                pair = mix(kh * _ODD + around)
                _, first, inv, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                twice = count[inv] > 1
                base = off[row]
                # covered runs, merged within a text
                c = np.flatnonzero(twice)
                s, e, r = _merge(row[c], lo[c], hi[c])
                own = kh[first]
                u, u_inv, u_count = np.unique(own, return_inverse=True, return_counts=True)
                hot = u_count[u_inv] >= HOT
                marks = u[u_count >= HOT]
                salt = np.where(hot, around[first].astype(np.int64) % SALT + 1, 0)
                f, none = row[first], np.zeros(len(marks), np.int64)
                cols = [
                    np.concatenate([mix(hs[x + r].view(np.uint64)), own, marks]).view(np.int64),
                    np.concatenate([e - off[r], pair[first].view(np.int64), none]),
                    np.concatenate([ids[x + r], ids[x + f], none]),
                    np.concatenate([hs[x + r], hs[x + f], none]),
                    np.concatenate([
                        _pack(s - off[r], 0, 0, 0, 0),
                        _pack((pos - base)[first], (pos - lo)[first], (hi - pos)[first], np.minimum(count, 2), salt),
                        _pack(none, 0, 0, 3, 0),
                    ]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["kh", "pair", "doc_id", "h", "packed"])

    return texts.mapInArrow(run, "kh long, pair long, doc_id long, h long, packed long")


def _pack(pos, left, right, kind, salt) -> np.ndarray:
    """pos, bytes before and after it, kind (0 covered run, 1 once, 2 twice, 3 mark of a hot seed) and salt in one word."""
    return (np.asarray(pos, np.int64) << 25) | (np.asarray(left, np.int64) << 17) | (np.asarray(right, np.int64) << 9) | (np.asarray(kind, np.int64) << 7) | salt


def _merge(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal covered runs; positions count through the buffer."""
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z, z
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # rows do not overlap in the buffer, so one running maximum serves all
    top = np.maximum.accumulate(hi)
    new = np.ones(len(row), bool)
    new[1:] = (lo[1:] > top[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return lo[at], np.maximum.reduceat(hi, at), row[at]


class Family:
    """Levels of sorted (pair, seed, count) arrays, each at most half the size of the one before."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, pair: np.ndarray, kh: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(pair, kind="stable")
        pair, kh, count = pair[order], kh[order], count[order]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return
        pair, kh, count = pair[at], kh[at], np.add.reduceat(count, at)
        for old, _, old_count in self.levels:  # merge-scan: what is known already is counted where it stands
            i = np.minimum(np.searchsorted(old, pair), len(old) - 1)
            known = old[i] == pair
            old_count[i[known]] += count[known]
            pair, kh, count = pair[~known], kh[~known], count[~known]
        if not len(pair):
            return
        level = (pair, kh, count)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            p, k, c = (np.concatenate(v) for v in zip(self.levels.pop(), level, strict=True))
            order = np.argsort(p, kind="stable")
            level = (p[order], k[order], c[order])
        self.levels.append(level)

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One level of all."""
        if not self.levels:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        p, k, c = (np.concatenate(v) for v in zip(*self.levels, strict=True))
        order = np.argsort(p, kind="stable")
        self.levels = [(p[order], k[order], c[order])]
        return self.levels[0]


def index_shards(rows: DataFrame) -> DataFrame:
    """Index rows dealt by shard -> doc_id, h, kind, s, e, kh, hot.

    COVER: [s, e) goes.  EDGE: the seed at s repeats with other surroundings.
    SOURCE: as EDGE, one place that stands for surroundings that are covered.
    """

    def run(batches):
        family, held, marked = Family(), [], []
        for b in batches:
            kh, pair, ids, hs, packed = (b.column(i).to_numpy() for i in range(5))
            kh, pos, kind = kh.view(np.uint64), packed >> 25, packed >> 7 & 3
            marked.append(kh[kind == 3])
            k = np.flatnonzero(kind == 0)
            if len(k):
                yield _verdicts(ids[k], hs[k], np.full(len(k), COVER, np.int8), pos[k], pair[k], np.zeros(len(k), np.uint64), np.zeros(len(k), bool))
            k = np.flatnonzero((kind == 1) | (kind == 2))
            if len(k):
                own = pair[k].view(np.uint64)
                family.add(own, kh[k], kind[k])
                held.append((kh[k], own, ids[k], hs[k], pos[k], pos[k] - (packed[k] >> 17 & 255), pos[k] + (packed[k] >> 9 & 255), (packed[k] & 127) > 0))
        p, k, n = family.closed()
        if not len(p):
            return
        u, inv, kinds = np.unique(k, return_inverse=True, return_counts=True)
        marks = np.unique(np.concatenate(marked)) if marked else np.zeros(0, np.uint64)
        is_marked = np.isin(u, marks) | (kinds > MANY)
        several = (kinds > 1) | is_marked
        used = np.zeros(len(p), bool)
        for kh, pair, ids, hs, pos, lo, hi, hot in held:
            i = np.searchsorted(p, pair)
            many, dup = several[inv[i]] | hot, n[i] > 1
            hot = hot | is_marked[inv[i]]
            cover = np.flatnonzero(dup)
            if len(cover):
                yield _verdicts(ids[cover], hs[cover], np.full(len(cover), COVER, np.int8), lo[cover], hi[cover], kh[cover] * np.uint64(0), hot[cover])
            first = np.zeros(len(i), bool)
            first[np.unique(i, return_index=True)[1]] = True
            source = dup & many & first & ~used[i]
            used[i[source]] = True
            e = np.flatnonzero((many & ~dup) | source)
            if len(e):
                yield _verdicts(ids[e], hs[e], np.where(source[e], SOURCE, EDGE).astype(np.int8), pos[e], pos[e], kh[e], hot[e])

    return rows.mapInArrow(run, "doc_id long, h long, kind byte, s int, e int, kh long, hot boolean")


def _verdicts(ids, hs, kind, s, e, kh, hot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, hs, kind, s.astype(np.int32), e.astype(np.int32), kh.view(np.int64), hot)], names=["doc_id", "h", "kind", "s", "e", "kh", "hot"])


def edges(joined: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, text, edges) -> the surroundings of edge seeds: grp, doc_id, h, own, a, at, cut.

    ``cut`` is the surroundings, ``a`` its start in the text, ``at`` the seed's
    place in it; ``own`` says whether the place itself is still undecided.
    For a hot seed a row stands for one part of the window starts.
    """
    reach = length - SEED

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["grp", "doc_id", "h", "own", "a", "at", "cut"])

    def run(batches):
        out = []
        for b in batches:
            raw, off = arrowbytes.flat(b.column(2))
            for r in range(b.num_rows):
                found = b.column(3)[r].as_py()
                if not found:
                    continue
                base, n = int(off[r]), int(off[r + 1] - off[r])
                text = raw[base : base + n]
                doc, h = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                prefix = Prefix(text) if any(f["hot"] for f in found) else None
                for f in found:
                    pos, own = f["s"], f["kind"] == EDGE
                    lo, hi = max(pos - reach, 0), min(pos + length, n)
                    if not f["hot"]:
                        out.append((f["kh"], doc, h, own, lo, pos - lo, text[lo:hi].tobytes()))
                        continue
                    for j in range(PARTS):
                        first, last = pos - reach * (j + 1) // PARTS, pos - reach * j // PARTS - (j > 0)
                        # every window that starts in first..last holds [last, first + length)
                        x, y = max(first, 0), min(last, n - length)
                        if x <= y:
                            key = prefix.ranges(np.array([last]), np.array([first + length])) + np.uint64(j + 1)
                            out.append((int(mix(key).view(np.int64)[0]), doc, h, own, x, pos - x, text[x : y + length].tobytes()))
                if len(out) >= CHUNK:
                    yield told(out)
                    out = []
            if out:
                yield told(out)
                out = []

    return joined.mapInArrow(run, "grp long, doc_id long, h long, own boolean, a int, at int, cut binary")


def windows(cuts: DataFrame, length: int) -> DataFrame:
    """Rows of ``edges``, dealt and sorted by grp -> doc_id, h, s, e: covered runs of undecided places."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        grp = t["grp"].to_numpy().view(np.uint64)
        cut = t["cut"].combine_chunks()
        off = np.frombuffer(cut.buffers()[1], np.int32, len(cut) + 1, cut.offset * 4).astype(np.int64)
        raw = np.frombuffer(cut.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        size = np.maximum(np.diff(off) - length + 1, 0)
        starts = arrowbytes.ragged(off[:-1], size)
        row = np.repeat(np.arange(len(size)), size)
        at = t["at"].to_numpy()[row] - (starts - off[row])
        key = mix(Prefix(raw).ranges(starts, starts + length) + at.astype(np.uint64) * _ODD + mix(grp)[row])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit &= t["own"].to_numpy()[row]
        k = np.flatnonzero(hit)
        if not len(k):
            return None
        s, e, r = _merge(row[k], starts[k], starts[k] + length)
        a = t["a"].to_numpy()[r]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (t["doc_id"].to_numpy()[r], t["h"].to_numpy()[r], (a + s - off[r]).astype(np.int32), (a + e - off[r]).astype(np.int32))], names=["doc_id", "h", "s", "e"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            grp = b.column(0).to_numpy()
            while b.num_rows:
                # whole groups of about CHUNK rows at a time
                if rows + b.num_rows < CHUNK:
                    held.append(b)
                    rows += b.num_rows
                    break
                want = max(0, CHUNK - rows - 1)
                new = np.flatnonzero(grp[1:] != grp[:-1]) + 1
                if held and len(grp) and grp[0] != held[-1].column(0)[held[-1].num_rows - 1].as_py():
                    new = np.concatenate([[0], new])
                new = new[new >= want]
                if not len(new):
                    held.append(b)
                    rows += b.num_rows
                    break
                held.append(b.slice(0, int(new[0])))
                if (out := solve(pa.Table.from_batches(held))) is not None:
                    yield out
                b, held, rows = b.slice(int(new[0])), [], 0
                grp = b.column(0).to_numpy()
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return cuts.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "doc_id long, h long, s int, e int")


def _stored_bytes(d: DataFrame) -> int:
    """The optimizer's estimate of a table's size, without a job; 0 where it knows none (it then says exabytes)."""
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def cover(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """orig, text, runs array<struct<s, e>> for every row: the covered byte runs (not merged)."""
    small_batches(docs.sparkSession)
    orig = F.col(doc_id).cast("long")
    texts = docs.select(F.coalesce(orig, F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"), orig.alias("orig"))
    rows = seeds(texts.select("doc_id", "h", "text"), length)
    keys = F.col("kh"), F.col("packed").bitwiseAND(127)
    # a shard's arrays are held by its task, so there are as many as the table's size asks for, or else as adaptive execution makes
    shards = -(-_stored_bytes(texts) // SHARD_BYTES)
    many = shards > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verdicts = materialize(index_shards(rows.repartition(min(shards, MAX_SHARDS), *keys) if many else rows.repartition(*keys)))
    # both joins ask for the same exchange of the texts
    found = verdicts.where(F.col("kind") != COVER).groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "kind", "kh", "hot")).alias("edges"))
    joined = texts.join(found, ["doc_id", "h"], "left").select("doc_id", "h", "text", "edges")
    runs = verdicts.where(F.col("kind") == COVER).select("doc_id", "h", "s", "e").unionByName(windows(edges(joined, length), length))
    runs = runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return texts.join(runs, ["doc_id", "h"], "left").select("orig", "text", "runs")


def remove(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left) for every row."""

    def run(batches):
        for b in batches:
            raw, off = arrowbytes.flat(b.column(1))
            runs = b.column(2)
            for x, y in arrowbytes.slices(off):  # rows out are small batches too, whatever size they came in
                n_removed, n_spans, kept = [], [], []
                for i in range(x, y):
                    t = raw[off[i] : off[i + 1]]
                    r = runs[i].values if runs[i].is_valid else None
                    if r is None or not len(r):
                        n_removed.append(0)
                        n_spans.append(0)
                        kept.append(t.tobytes())
                        continue
                    s, e, _ = _merge(np.zeros(len(r), np.int64), r.field(0).to_numpy().astype(np.int64), r.field(1).to_numpy().astype(np.int64))
                    n_removed.append(int((e - s).sum()))
                    n_spans.append(len(s))
                    cuts = np.concatenate([[0], np.stack([s, e], 1).reshape(-1), [len(t)]]).tolist()
                    kept.append(b"".join(t[cuts[k] : cuts[k + 1]].tobytes() for k in range(0, len(cuts), 2)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(np.diff(off[x : y + 1])), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return cover(docs, length, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


#: The rows of ``remove`` with the kept bytes' digest, for DuckDB: every 200-byte window (400 hex digits) by its 64-bit hash.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rn, i, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT rn, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
hit AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
mark AS (SELECT rn, i, sum(CASE WHEN i <= last + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rn ORDER BY i) AS run FROM (SELECT rn, i, lag(i, 1, -1000) OVER (PARTITION BY rn ORDER BY i) AS last FROM hit)),
span AS (SELECT rn, run, min(i) AS a, max(i) + 200 AS b FROM mark GROUP BY ALL),
gap AS (SELECT rn, lag(b, 1, 0) OVER (PARTITION BY rn ORDER BY a) AS a, a AS b FROM span UNION ALL SELECT rn, max(b), NULL FROM span GROUP BY rn),
kept AS (SELECT rn, string_agg(substr(x, 2 * a + 1, coalesce(2 * (b - a), length(x))), '' ORDER BY a) AS x FROM gap JOIN d USING (rn) GROUP BY rn),
n AS (SELECT rn, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY rn)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN n USING (rn) LEFT JOIN kept USING (rn)
"""

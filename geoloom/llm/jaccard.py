"""Exact n-gram Jaccard join: size-banded tiles with bitmap signatures.

1. Every document becomes its sorted array of distinct shingle hashes, a key of
   the whole set, and a parity bitmap of at least twice as many bits as the set
   has shingles.  Documents with equal sets are one class from here on.
2. A linked pair must share a token among each one's first
   ``n - ceil(t n) + 1`` in one common order (prefix filter).  Frequent tokens
   stand last in that order, so common passages do not make large groups.
3. Classes that share a prefix token meet in tiles: a tile holds one token and
   two neighbouring size bands (a band spans the factor t), and large groups
   are cut into blocks that meet pair by pair, so no group is gathered whole.
   In a tile the bit count of two bitmaps' difference bounds the overlap from
   above; a spanning forest of the pairs that pass goes out.
4. The connected candidates are families.  Their arrays meet in tiles of the
   same kind, where each pair that passes the bitmap bound and is not linked
   already gets the exact intersection of sorted arrays; again a spanning forest
   of the true links goes out, and its components are the result.
5. In a family of more than LARGE classes all blocks meeting all blocks would
   grow with its square.  There the pairs of the forest are checked first, each
   on its own.  What they link to the family's main part needs no more
   comparing; only the classes left over meet each other and the main part.

Shingles are 64-bit hashes; sets are keyed by 128 bits.  No pair is dropped by a
cap: blocks and bands only say where two documents meet.

Defined results: a null text and one without words have no shingles and link
with nothing; a shorter text is one shingle; rows with equal ids are one node;
a null id has no component; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import arrowbytes, shingles
from geoloom.llm.common import materialize, small_batches
from geoloom.llm.hashing import mix
from geoloom.operators.components import connected_components

#: Tokens in more documents than this may be put last; the list of them holds
#: HOT_TOKENS entries at most.  Any choice is exact, it only shapes the tiles.
HOT_DF, HOT_TOKENS = 64, 1 << 20
BLOCK, SMALL = 1024, 128
#: Classes from which a family is settled by pairs first, and pairs that one copy of a text's array serves.
LARGE, DEGREE = 4 * BLOCK, 256
#: Bytes of text whose shingles are worked out at once.
SLICE_BYTES = 1 << 20


def _pairs_ok(n_i, n_j, overlap, percent: int):
    """percent * union <= 100 * overlap, in integers."""
    return (100 + percent) * overlap >= percent * (n_i + n_j)


def hot_tokens(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of frequent shingles: three or more times in a slice, HOT_DF or more in all."""

    def run(batches):
        for b in batches:
            raw, off = arrowbytes.flat(b.column(0))
            for a, z in arrowbytes.slices(off):
                parts = [shingles.sets(raw[off[a + x] : off[a + y]], off[a + x : a + y + 1] - off[a + x], size)[0] for x, y in arrowbytes.slices(off[a : z + 1], SLICE_BYTES)]
                u, c = np.unique(np.concatenate(parts), return_counts=True)
                k = c >= 3
                yield pa.RecordBatch.from_arrays([pa.array(u[k].view(np.int64)), pa.array(c[k].astype(np.int64))], names=["h", "c"])

    counts = materialize(texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_DF))
    steps = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    total, least = 0, HOT_DF
    for r in steps:  # the largest power of two of counts whose tokens fit the bound
        total += r.n
        if total > HOT_TOKENS:
            least = 2 ** (r.s + 1)
            break
    got = counts.where(F.col("c") >= least).select("h").toArrow().column(0).to_numpy()
    return np.sort(got.view(np.uint64))


def bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap: bit b is the parity of the number of hashes that fall on b."""
    bits = max(64, 1 << int(2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps at ``width`` bytes: a wider one becomes the exclusive or of its parts.

    Bits are numbered by the hash's low bits, so the parts of a wide bitmap lie
    over each other when its width is halved, and the difference of two folded
    bitmaps still has at most as many bits as the sets differ in shingles.
    """
    rows = [np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) if len(m) > width else np.frombuffer(m, np.uint8) for m in maps]
    return np.stack(rows).view(np.uint64)


def signatures(texts: DataFrame, size: int, percent: int, hot: np.ndarray) -> DataFrame:
    """texts (doc_id, text) -> doc_id, n, k1, k2, prefix, bitmap."""
    held = texts.sparkSession.sparkContext.broadcast(hot)  # HOT_TOKENS * 8 bytes at most

    def run(batches):
        top = held.value
        for b in batches:
            raw, off = arrowbytes.flat(b.column(1))
            for x, y in arrowbytes.slices(off, SLICE_BYTES):
                h, count = shingles.sets(raw[off[x] : off[y]], off[x : y + 1] - off[x], size)
                ends = np.cumsum(count)
                frequent = top[np.minimum(np.searchsorted(top, h), len(top) - 1)] == h if len(top) else np.zeros(len(h), bool)
                some = np.flatnonzero(count)
                k1, k2 = np.zeros(y - x, np.uint64), np.zeros(y - x, np.uint64)
                if len(some):
                    k1[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), (ends - count)[some])
                    k2[some] = np.add.reduceat(mix(h + np.uint64(0x14057B7EF767814F)), (ends - count)[some])
                prefix, maps = [], []
                for s, e in zip((ends - count).tolist(), ends.tolist(), strict=True):
                    n, own = e - s, h[s:e]
                    want = n - -(-percent * n // 100) + 1 if n else 0
                    f = frequent[s:e]
                    first = own[~f][:want] if f.any() else own[:want]
                    prefix.append(np.concatenate([first, own[f][: want - len(first)]]) if len(first) < want else first)
                    maps.append(bitmap(own))
                flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
                at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(x, y - x), pa.array(count.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array(maps, pa.binary()),
                    ],
                    names=["doc_id", "n", "k1", "k2", "prefix", "bitmap"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, bitmap binary")


def _tiles(rows: DataFrame, group: str, percent: int) -> DataFrame:
    """Deal rows (group, cid, n, cnt, ...) to tiles (group, size band, two blocks).

    A group of up to SMALL rows is one tile, in which sizes are compared in
    order.  In a larger one a row goes to the tiles of its band and of the band
    below; a group of more than BLOCK rows is cut into blocks by a hash of the
    class, and each block meets every block.
    """
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    blocks = F.ceil(F.col("cnt") / BLOCK).cast("int")
    d = rows.withColumn("band", band).withColumn("blk", F.pmod(F.xxhash64("cid", F.lit(5)), blocks).cast("int"))
    d = d.withColumn("tband", F.explode(F.when(F.col("cnt") <= SMALL, F.array(F.lit(-9))).otherwise(F.array(F.col("band"), F.col("band") - 1))))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return d.withColumn("tile", F.xxhash64(group, "tband", F.least("blk", "other"), F.greatest("blk", "other"))).drop("band", "tband", "blk", "other", "cnt")


def _forest(cid: np.ndarray, n: np.ndarray, maps: list[bytes], percent: int, exact=None, joined=None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Star edges (member, smallest member) of the components that passing pairs make, and the pairs that made them.

    ``exact(i, j)`` decides a pair that passed the bitmap bound; without it the
    bound decides.  Rows are compared in the order of their sizes, each with those
    up to its size over the threshold.  ``joined`` marks rows known to be one component.
    """
    order = np.lexsort((cid, n))
    cid, n = cid[order], n[order]
    stop = np.searchsorted(n, n * 100 // percent, side="right")
    width = np.array([len(maps[k]) for k in order])  # grows with n
    label, pairs = np.arange(len(cid)), []
    if joined is not None:
        one = np.flatnonzero(joined[order])
        label[one] = one[:1]
    for w in np.unique(width):
        # rows of this width meet each other and the larger ones at this width
        first, last = np.searchsorted(width, w), np.searchsorted(width, w, side="right")
        bits = _fold([maps[k] for k in order[first : stop[last - 1]]], int(w))
        for i in range(first, last):
            j = np.arange(i + 1, stop[i])
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            apart = np.bitwise_count(bits[j - first] ^ bits[i - first]).sum(1, dtype=np.int64)
            j = j[_pairs_ok(n[i], n[j], (n[i] + n[j] - apart) // 2, percent)]
            for k in j.tolist():
                if label[k] != label[i] and (exact is None or exact(order[i], order[k])):
                    label[label == label[k]] = label[i]
                    pairs.append((int(cid[i]), int(cid[k])))
    least = np.full(len(cid), np.iinfo(np.int64).max)
    np.minimum.at(least, label, cid)
    return [(c, m) for c, m in zip(cid.tolist(), least[label].tolist(), strict=True) if c != m], pairs


def _by_tile(batches, fields: list[str]):
    """The rows of each tile, from batches sorted by tile: dicts of columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        tile = b.column(b.schema.get_field_index("tile")).to_numpy()
        cut = np.flatnonzero(np.diff(tile)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(tile)], strict=True):
            if e == s:
                continue
            if last is not None and tile[s] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = tile[s]
    if held:
        yield pa.Table.from_batches(held)


def _edges(star: list[tuple[int, int]], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = [*star, *pairs]
    ends = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*ends, pa.array([False] * len(star) + [True] * len(pairs))], names=["a", "b", "pair"])


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (a, b, pair) of candidate pairs among classes (cid, k1, k2, n, prefix, bitmap).

    ``pair`` marks pairs that passed the bound; the other edges are stars over the same components.
    """
    # a class is told by its key: texts of one id may be several classes
    post = reps.select("cid", F.xxhash64("k1", "k2", "n").alias("class"), F.explode("prefix").alias("token"))
    group = Window.partitionBy("token")
    post = post.withColumn("cnt", F.count("*").over(group)).where("cnt > 1")
    post = materialize(post.withColumn("sig", F.expr("bit_xor(xxhash64(class)) over (partition by token)")))
    # tokens with the same members are one group
    kept = post.groupBy("sig", "cnt").agg(F.min("token").alias("token")).select(F.col("token").alias("kept"))
    post = post.join(kept, post.token == kept.kept, "left_semi").select("token", "class", "cnt")
    rows = post.join(reps.select("cid", F.xxhash64("k1", "k2", "n").alias("class"), "n", "bitmap"), "class").drop("class")
    dealt = _tiles(rows, "token", percent).repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        for t in _by_tile(batches, []):
            if t.num_rows < 2:
                continue
            star, pairs = _forest(t["cid"].to_numpy(), t["n"].to_numpy(), t["bitmap"].to_pylist(), percent)
            if star:
                yield _edges(star, pairs)

    return dealt.mapInArrow(run, "a long, b long, pair boolean").distinct()


def true_pairs(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are linked, each checked on its own: no task holds more than a few pairs' arrays.

    An id of several texts is linked by any of them.
    """
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("doc_id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("doc_id")))).alias("e"))
    ends = materialize(ends.select("a", "b", "e.side", "e.doc_id"))
    # a text that many pairs ask for is dealt to several places
    asked = ends.groupBy("doc_id").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("places"))
    ends = ends.join(asked.hint("merge"), "doc_id").withColumn("place", F.pmod(F.xxhash64("a", "b"), F.col("places")).cast("int")).drop("places")

    wanted = texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "places")
    held = _with_sets(wanted, size).where("n > 0").drop("n", "bitmap")
    held = held.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    sides = ends.join(held, ["doc_id", "place"]).select(F.xxhash64("a", "b").alias("tile"), "a", "b", "side", "h")
    dealt = sides.repartition("tile").sortWithinPartitions("tile", "a", "b", "side")

    def run(batches):
        for t in _by_tile(batches, []):
            a, b, side, h = t["a"].to_numpy(), t["b"].to_numpy(), t["side"].to_numpy(), t["h"].combine_chunks()
            sets = [h[k].values.to_numpy().view(np.uint64) for k in range(len(h))]
            found = set()
            for i in np.flatnonzero(side == 0).tolist():
                for j in np.flatnonzero((side == 1) & (a == a[i]) & (b == b[i])).tolist():
                    p = np.searchsorted(sets[j], sets[i])
                    overlap = int((sets[j][np.minimum(p, len(sets[j]) - 1)] == sets[i]).sum())
                    if _pairs_ok(len(sets[i]), len(sets[j]), overlap, percent):
                        found.add((int(a[i]), int(b[i])))
            if found:
                yield _edges(sorted(found), [])

    return dealt.mapInArrow(run, "a long, b long, pair boolean").drop("pair")


def _settle_large(texts: DataFrame, edges: DataFrame, families: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(families that all meet in tiles, true edges within the larger ones)."""
    large = families.where(F.col("cnt") > LARGE)
    if large.isEmpty():
        return families, edges.where("false").select("a", "b")
    ask = edges.where("pair").join(large.select(F.col("cid").alias("a")), "a", "left_semi").select("a", "b")
    part = connected_components(true_pairs(texts, ask, size, percent))
    known = materialize(large.join(part, large.cid == part.node, "left").select("cid", "family", F.coalesce("component", "cid").alias("part")))
    sizes = known.groupBy("family", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    rest = known.join(main, "family").where("outside > 0").select("cid", "family", (F.col("part") != F.col("main")).alias("out"), "inside", "outside")
    found = _left_over(texts, rest, size, percent).unionByName(known.select(F.col("cid").alias("a"), F.col("part").alias("b")))
    return families.where(F.col("cnt") <= LARGE), found


def _left_over(texts: DataFrame, rest: DataFrame, size: int, percent: int) -> DataFrame:
    """True edges (a, b) of the classes outside their family's main part: with one another and with it."""
    inside, outside = F.ceil(F.col("inside") / BLOCK).cast("int"), F.ceil(F.col("outside") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cid", F.lit(5)), F.when(F.col("out"), outside).otherwise(inside)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.when(F.col("out"), F.transform(upto(inside), lambda i: F.xxhash64("family", F.lit(0), i, "blk"))).otherwise(F.transform(upto(outside), lambda o: F.xxhash64("family", F.lit(0), "blk", o)))
    among = F.when(F.col("out"), F.transform(upto(outside), lambda o: F.xxhash64("family", F.lit(1), F.least(o, F.col("blk")), F.greatest(o, F.col("blk"))))).otherwise(F.array().cast("array<long>"))
    d = rest.withColumn("blk", block).select(F.col("cid").alias("doc_id"), "out", F.concat(across, among).alias("tiles"))
    got = _with_sets(texts.join(d.hint("merge"), "doc_id").select("doc_id", "text", "out", "tiles"), size).where("n > 0")
    dealt = got.withColumn("tile", F.explode("tiles")).drop("tiles").repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        for t in _by_tile(batches, []):
            if t.num_rows < 2:
                continue
            n = t["n"].to_numpy()
            _, pairs = _forest(t["doc_id"].to_numpy(), n, t["bitmap"].to_pylist(), percent, _exact(t, percent), ~t["out"].to_numpy())
            if pairs:
                yield _edges(pairs, [])

    return dealt.mapInArrow(run, "a long, b long, pair boolean").drop("pair")


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with n, bitmap and the sorted array h of the text's shingles instead of the text."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("n", T.LongType()), T.StructField("bitmap", T.BinaryType()), T.StructField("h", T.ArrayType(T.LongType()))])
    names = [f.name for f in schema.fields]

    def arrays(batches):
        for b in batches:
            raw, off = arrowbytes.flat(b.column(b.schema.get_field_index("text")))
            for x, y in arrowbytes.slices(off, SLICE_BYTES):
                h, count = shingles.sets(raw[off[x] : off[y]], off[x : y + 1] - off[x], size)
                at = np.concatenate([[0], np.cumsum(count)])
                maps = [bitmap(h[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                kept = [b.column(b.schema.get_field_index(f.name)).slice(x, y - x) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count.astype(np.int64)), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=names)

    return rows.mapInArrow(arrays, schema)


def _exact(t: pa.Table, percent: int):
    """Whether rows i and j of a tile are truly linked, from their sorted arrays."""
    h, n = t["h"].combine_chunks(), t["n"].to_numpy()
    values, at = h.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])

    def exact(i, j):
        a, b = values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]
        p = np.searchsorted(b, a)
        overlap = int((b[np.minimum(p, len(b) - 1)] == a).sum())
        return _pairs_ok(int(n[i]), int(n[j]), overlap, percent)

    return exact


def true_edges(texts: DataFrame, families: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning edges of the true links within families (cid, family, cnt)."""
    members = families.select(F.col("cid").alias("doc_id"), "family", "cnt")
    rows = texts.join(members.hint("merge"), "doc_id").select("doc_id", "text", "family", "cnt")
    got = _with_sets(rows, size).where("n > 0").withColumnRenamed("doc_id", "cid")
    dealt = _tiles(got, "family", percent).repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        for t in _by_tile(batches, []):
            if t.num_rows < 2:
                continue
            star, _ = _forest(t["cid"].to_numpy(), t["n"].to_numpy(), t["bitmap"].to_pylist(), percent, _exact(t, percent))
            if star:
                yield _edges(star, [])

    return dealt.mapInArrow(run, "a long, b long, pair boolean").drop("pair")


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of ``size``-word shingles.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = materialize(signatures(texts, size, percent, hot_tokens(texts.select("text"), size)))
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("cid"))
    classes = materialize(classes)
    ids = classes.select(F.col("cid").alias("rep"), "k1", "k2")
    reps = sig.join(ids, (sig.doc_id == ids.rep) & (sig.k1 == ids.k1) & (sig.k2 == ids.k2), "left_semi").select(F.col("doc_id").alias("cid"), "k1", "k2", "n", "prefix", "bitmap")
    reps = reps.dropDuplicates(["cid", "k1", "k2", "n"])  # one row a class: members of a token are keyed by an exclusive or
    edges = materialize(candidate_edges(reps, percent))
    maybe = connected_components(edges.where("NOT pair"))
    sizes = maybe.groupBy("component").agg(F.count("*").alias("cnt"))
    families = materialize(maybe.join(sizes, "component").select(F.col("node").alias("cid"), F.col("component").alias("family"), "cnt"))
    families, settled = _settle_large(texts, edges, families, size, percent)
    found = connected_components(true_edges(texts, families, size, percent).unionByName(settled))
    named = classes.join(found, classes.cid == found.node, "left").select("k1", "k2", "n", F.coalesce("component", "cid").alias("comp"))
    s, c = sig.select("doc_id", "n", "k1", "k2").alias("s"), named.alias("c")
    joined = s.join(c, (F.col("s.k1") == F.col("c.k1")) & (F.col("s.k2") == F.col("c.k2")) & (F.col("s.n") == F.col("c.n")), "left")
    component = F.when(F.col("s.doc_id").isNotNull(), F.coalesce(F.col("c.comp"), F.col("s.doc_id")))
    return joined.select(F.col("s.doc_id").alias("doc_id"), F.col("s.n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id, with the columns of ``docs``.

    Rows equal in id and text stay once.  A row with a null id takes part under
    an id of its text's hash, beyond all usual ones, so exact copies of it are one
    document and it goes where a near copy has an id.  Documents without words
    link with nothing and stay.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)).bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(1 << 62)))
    keyed = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    told = F.col("row")[text]
    c = similar_components(keyed.select("key", told.alias("text")), size, percent, "key", "text")
    keep = materialize(c.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct())
    # the join and the choice among repeated rows ask for the same exchange
    kept = keyed.join(keep.hint("merge"), "key", "left_semi")
    same = Window.partitionBy("key").orderBy(F.xxhash64(told))
    return kept.withColumn("again", F.row_number().over(same) - F.rank().over(same)).where("again = 0").select("row.*")


#: The rows of ``similar_components`` for ``size`` 4 and ``percent`` 85: sets of shingles, pairs by common shingles, reachable ids.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rn, doc_id, g FROM (
    SELECT rn, doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
    UNION ALL SELECT rn, doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT rn, doc_id, count(*) AS n FROM s GROUP BY ALL),
common AS (SELECT a.rn AS a, b.rn AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rn < b.rn GROUP BY ALL),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM common JOIN n x ON x.rn = a JOIN n y ON y.rn = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT doc_id AS v, doc_id AS r FROM d WHERE doc_id IS NOT NULL UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v WHERE reach.r < e.b),
best AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, best.component_id FROM d LEFT JOIN n USING (rn) LEFT JOIN best ON best.v = d.doc_id
"""

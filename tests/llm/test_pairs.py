"""Pair operators against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import anchors, decontaminate, jaccard, repeats


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        u, v = sorted((find(a), find(b)))
                        parent[v] = u
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("size, percent, block, small", [(4, 85, 1024, 128), (5, 80, 2, 1), (2, 50, 3, 2)])
def test_jaccard(docs, monkeypatch, size, percent, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HOT_DF", 3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows, size, percent)
    got = jaccard.similar_components(docs, size, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("large, degree, block", [(4096, 256, 1024), (8, 256, 1024), (8, 3, 4), (30, 256, 7)])
def test_jaccard_many_variants(spark, monkeypatch, large, degree, block):
    """A family in which some pairs link and others do not, and one in which all do."""
    import random

    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "DEGREE", degree)
    monkeypatch.setattr(jaccard, "BLOCK", block)

    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    tight = [f"t{k}" for k in range(150)]
    rows += [(100 + i, " ".join([*tight[: 3 * i], f"x{i}", *tight[3 * i + 1 :]])) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, 4, 85)
    assert 2 < len(set(want.values())) < 60 and {want[k] for k in range(100, 140)} == {100}
    assert {r.doc_id: r.component_id for r in jaccard.similar_components(d, 4, 85).collect()} == want


def test_jaccard_empty_and_choice(empty, docs):
    assert jaccard.similar_components(empty, 4, 85).count() == 0
    kept = jaccard.one_of_each(docs)
    ids = [r.doc_id for r in kept.collect()]
    # the row without an id is a near copy of 5 and goes; null and wordless texts with ids stay
    assert kept.columns == docs.columns and None not in ids and len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and 7 not in ids and 0 in ids and 1 in ids


def brute_repeats(texts, length):
    bs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bs for i in range(len(b) - length + 1))
    out = []
    for b in bs:
        cov = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cov[i] += 1
                cov[i + length] -= 1
        hit = np.cumsum(cov)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out.append((len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, hot, many, shard", [(200, 16, 4096, 1 << 27), (200, 2, 2, 1 << 27), (60, 16, 2, 1 << 10), (40, 3, 4096, 1 << 27)])
def test_repeats(docs, monkeypatch, length, hot, many, shard):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "CHUNK", 7)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(zip([r.doc_id for r in rows], brute_repeats([r.text for r in rows], length), strict=True), key=repr)
    got = repeats.remove(docs, length).collect()
    assert sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in got), key=repr) == want


def test_repeats_empty(empty):
    assert repeats.remove(empty).count() == 0


def test_every_window_selects_by_content():
    r = np.random.default_rng(1)
    a = r.integers(97, 100, 3000, dtype=np.uint8)
    b = np.concatenate([r.integers(97, 100, 777, dtype=np.uint8), a[500:900]])
    pos, _ = anchors.select(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 200)
    for s in range(500, 701):
        mine, other = pos[(pos >= s) & (pos <= s + 200 - anchors.SEED)] - s, pos[(pos >= len(a) + 777 + s - 500) & (pos <= len(a) + 777 + s - 500 + 200 - anchors.SEED)] - (len(a) + 777 + s - 500)
        assert set(mine) & set(other)


def test_family_keeps_logarithmic_levels():
    f, r = repeats.Family(), np.random.default_rng(3)
    total = Counter()
    for _ in range(40):
        p = r.integers(0, 3000, 200).astype(np.uint64)
        f.add(p, p // np.uint64(7), np.ones(200, np.int64))
        total.update(p.tolist())
        sizes = [len(x[0]) for x in f.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 12
    p, _, n = f.closed()
    assert dict(zip(p.tolist(), n.tolist(), strict=True)) == dict(total)


def test_distance():
    import random

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(200):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert decontaminate.distance(p, t) == plain(p, t)


def test_decontaminate(spark, docs, odd_texts, empty):
    """Planted exact and edited items are found, at brute-force distances; clean texts are not."""
    rng = np.random.default_rng(9)
    items = [(k, t[:230]) for k, t in enumerate(odd_texts[60:75])] + [(90, None), (91, ""), (92, "Short item")]
    assert len(items) > 10
    low = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").translate({c: c + 32 for c in range(65, 91)})).lstrip(" ").encode()
    plant = []
    for k, (_, t) in enumerate(items[:8]):
        b = list(t)
        for _ in range(k * 2):
            b[int(rng.integers(len(b)))] = "q"
        plant.append((1000 + k, f"{odd_texts[5][:300]} {''.join(b).upper() if k % 2 else ''.join(b)}\n {odd_texts[6][:90]}"))
    plant.append((2000, "has a short   ITEM in it"))
    extra = spark.createDataFrame(plant, "doc_id long, text string")
    d = docs.select("doc_id", "text").where("doc_id < 55").unionByName(extra)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(d, bench).collect()}
    want = {}
    for r in d.collect():
        for i, t in items:
            p = low(t).strip()
            if p and len(p) >= decontaminate.SEED:
                e = decontaminate.distance(p, low(r.text))
                if e <= int(0.2 * len(p)):
                    want[r.doc_id, i] = e
    want[2000, 92] = 0
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and {(1000 + k, k) for k in range(8)} <= set(got)
    kept = {r.doc_id for r in decontaminate.clean(d, bench).collect()}
    assert kept == {r.doc_id for r in d.collect()} - {k[0] for k in got}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(d, bench.limit(0)).count() == 0


def test_blocks_of_items(spark, docs, odd_texts, monkeypatch):
    bench = spark.createDataFrame([(k, t[:150]) for k, t in enumerate(odd_texts[60:66])], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert one and sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=repr) == one


@pytest.mark.parametrize("even", [False, True])
def test_edits_up_to_the_limit_are_all_found(spark, even):
    """Edits so dense that no long run survives, at random places and at every fifth byte."""
    rng, words = np.random.default_rng(3), [bytes(w) for w in np.random.default_rng(4).integers(97, 110, (60, 4), dtype=np.uint8)]
    prose = lambda n: b" ".join(words[k] for k in rng.integers(0, 60, n))
    items = [prose(int(n)) for n in rng.integers(4, 70, 40)]
    limits = [len(t) // 5 for t in items]
    texts = []
    for k, t in enumerate(items):
        b = bytearray(t)
        for e in range(limits[k]):
            b[5 * e + 4 if even else int(rng.integers(len(b)))] = 35
        texts.append(prose(50) + b" " + bytes(b) + b" " + prose(30))
    want = {(r, i): d for r, t in enumerate(texts) for i, p in enumerate(items) if (d := decontaminate.distance(p, t)) <= limits[i]}
    assert {(k, k) for k in range(40)} <= set(want)
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, bench).collect()} == want


@pytest.mark.parametrize("percent", [5, 10, 15, 20])
def test_search_finds_planted_edits(percent):
    """Bytes replaced, put in and left out at random places of items of many sizes: every match that brute force finds, at its distance."""
    r, words = np.random.default_rng(percent), [bytes(w) for w in np.random.default_rng(4).integers(97, 123, (90, 6), dtype=np.uint8)]
    prose = lambda n: b" ".join(words[k] for k in r.integers(0, 90, n))
    items = [prose(60)[: int(n)].strip() for n in [*range(16, 60, 3), *r.integers(60, 400, 15)]]
    index = decontaminate.build([(k, t.decode()) for k, t in enumerate(items)])
    assert index.recall >= decontaminate.RECALL
    texts = []
    for t in items:
        a = np.frombuffer(t, np.uint8)
        for _ in range(3):
            texts.append(prose(9) + b" " + decontaminate._edited(r, a, percent * len(a) // 100).tobytes() + b" " + prose(7))
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = decontaminate._search(index, np.frombuffer(b"".join(texts), np.uint8), off)
    want = {(j, i): d for j, t in enumerate(texts) for i, p in enumerate(items) if (d := decontaminate.distance(p, t)) <= index.limits[i]}
    assert len(want) >= 85 and got == want


def test_long_item(spark):
    """An item of many thousand bytes among short ones."""
    r = np.random.default_rng(8)
    long = bytes(r.integers(97, 123, 30_000, dtype=np.uint8))
    edited = decontaminate._edited(r, np.frombuffer(long, np.uint8), 900).tobytes()
    docs = spark.createDataFrame([(1, f"before {edited.decode()} after"), (2, "a line of forty bytes that has no secret"), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, long.decode()), (8, "A line of forty bytes that hxs no secret")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 8)} and got[2, 8] == 1 and 0 < got[1, 7] <= 900


def test_jaccard_texts_of_one_id(spark):
    """An id with two texts links through both, and rows without an id are documents of their own."""
    a, b, c = ([f"{x}{j}" for j in range(60)] for x in "abc")
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [(5, near(a, 0)), (5, near(b, 0)), (7, near(a, 1)), (8, near(b, 1)), (9, near(c, 0)), (None, near(c, 1)), (None, near(c, 1)), (None, "alone " + " ".join(a[:20])), (None, None), (11, ""), (11, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar_components(d, 4, 85).collect() if r.doc_id is not None}
    assert got == {5: 5, 7: 5, 8: 5, 9: 9, 11: 11}
    clash = d.selectExpr("doc_id", "text", "1 AS keep_id", "2 AS key", "3 AS again")
    kept = jaccard.one_of_each(clash, 4, 85)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect()) == sorted([(5, near(a, 0)), (5, near(b, 0)), (9, near(c, 0)), (-1, "alone " + " ".join(a[:20])), (-1, ""), (11, "")])


def test_jaccard_table_with_itself(spark):
    """Every row twice: pairs of near copies stay linked."""
    rows = []
    for k in range(12):
        w = [f"t{k}x{j}" for j in range(60)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-1], "other"]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d = d.unionAll(d)
    want = brute_components(rows, 4, 85)
    assert len(set(want.values())) == 12
    got = jaccard.similar_components(d, 4, 85).collect()
    assert len(got) == 48 and {r.doc_id: r.component_id for r in got} == want

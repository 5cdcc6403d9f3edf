"""Learned operators: held-out accuracy, folding, defined results."""

import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import langid, toxicity
from geoloom.llm.common import held_out, read
from geoloom.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    rows = QUERIES["op6_language_id"](spark, BIG).join(read(spark, BIG, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd(spark, docs, empty):
    x = np.zeros((8, langid.WINDOW), np.uint8)
    m = langid.train(langid.Model(["de", "en"]), x, np.array([0, 1] * 4), epochs=1)
    rows = langid.identify(docs, m).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    assert langid.identify(empty, m).count() == 0 and langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.fit(docs.where(held_out(F.col("doc_id")))) is None


def test_network_tables_equal_plain_convolution():
    m, r = langid.Model(["a", "b", "c"]), np.random.default_rng(0)
    x = r.integers(0, 128, (3, langid.WINDOW)).astype(np.uint8)
    feats = []
    for w, c, b in zip(langid.WIDTHS, m.conv, m.bias, strict=True):
        e = m.emb[x]
        a = np.stack([np.concatenate([e[:, i + j] for j in range(w)], axis=1) @ c for i in range(langid.WINDOW - w + 1)], axis=1)
        feats.append(a.max(1) + b)
    assert np.allclose(m.pooled(x, m.tables()), np.maximum(np.hstack(feats), 0), atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 10, b"b" * langid.WINDOW, b"c" * (3 * langid.WINDOW + 1)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    _, rows, size = langid.windows(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert rows.tolist() == [1, 2, 3, 3, 3, 3] and size.tolist() == [10, langid.WINDOW, *[langid.WINDOW] * 3, 1]


def test_folding():
    assert toxicity.fold("1d10t") == toxicity.fold("IDIOT") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ") == toxicity.fold("id​iot")
    assert toxicity.fold("$tup1d") == toxicity.fold("Stupid") and toxicity.fold("Straße") != toxicity.fold("Strase")


def test_hits_equal_a_plain_scan():
    """The automaton against every entry tried at every place of many texts."""
    rng = random.Random(3)
    letters = "abc "
    entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): rng.random() + 0.1 for _ in range(25)}
    phrases = frozenset(f"{a}{rng.choice('abc')} {b}" for a in list(entries)[:6] for b in list(entries)[6:12])
    for exceptions in (frozenset(), phrases):
        m = toxicity.Matcher(toxicity.Model(entries, exceptions))
        for _ in range(300):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
            want = []
            for s in range(len(t)):
                here = [e for e in entries if t.startswith(e, s)]
                if here and (s == 0 or not t[s - 1].isalnum()) and not any(p in exceptions for p in toxicity.phrases(t, s)):
                    best = max(here, key=len)
                    want.append((s, s + len(best), entries[best]))
            assert m.hits(t) == want


def _labelled(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    plain = "river stone cloud meadow lantern harbour window garden bridge market".split()
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grobbly", "grobblish", "Gr0bbled", "snarkful"])
        elif i % 3 == 0:
            w[5:7] = ["snarkful", "lantern"]
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark)
    m = toxicity.fit(toxicity.training_rows(docs, labels))
    assert any(toxicity.fold("grobbl").startswith(k) for k in m.entries) and len(m.entries) < 40
    rows = toxicity.score(docs, m).join(labels.where("toxic is not null"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows]) > 0.95
    hit = toxicity.Matcher(m)
    assert hit.score("such a grobbled thing " * 2) > hit.score("such a calm thing") and hit.score("") == hit.score("calm")
    assert hit.hits(toxicity.fold("xgrobbly")) == []


def test_toxicity_held_out(spark):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.1").join(read(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.03


def test_toxicity_odd(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(toxicity.training_rows(docs, labels))
    assert {r.score for r in toxicity.score(docs, m).collect()} == {0.0} and toxicity.score(empty, m).count() == 0
    m = toxicity.Model({"amber": 3.0}, frozenset({"amber birch"}), (-1.0, 1.0, 1.0))
    s = toxicity.Matcher(m)
    assert s.score("amber birch") == s.score("") < s.score("amber cedar") and len(toxicity.score(docs, m).collect()) == docs.count()

"""The pipeline's stages against brute force on the driver's smallest table."""

import re

import public_tokenizers

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import decontaminate, langid, sentencepieces
from geoloom.llm.common import materialize, read

from .test_pairs import brute_components


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    kept = {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        kept[name] = docs.collect()
        if name != names[-1]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    first = {r.doc_id for r in read(spark, sf, "documents").collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept["language_id"]} == first
    want = brute_components([(r.doc_id, r.text) for r in kept["language_id"]], 5, 80)
    assert {r.doc_id for r in kept["near_duplicates"]} == set(want.values())
    low = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").translate({c: c + 32 for c in range(65, 91)})).lstrip(" ").encode()
    items = [low(r.text).strip() for r in read(spark, sf, "benchmark").collect()]
    clean = {r.doc_id for r in kept["near_duplicates"] if not any(p in low(r.text) for p in items)}
    assert {r.doc_id for r in kept["decontamination"]} <= clean
    for r in kept["near_duplicates"]:
        if r.doc_id in clean and r.doc_id not in {x.doc_id for x in kept["decontamination"]}:
            assert any(decontaminate.distance(p, low(r.text)) <= 0.2 * len(p) for p in items)
    before = {r.doc_id: r.text for r in kept["decontamination"]}
    hexes = re.compile("[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}")
    for r in kept["secret_scan"]:
        assert not hexes.search(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
    v = sentencepieces.vocabulary(public_tokenizers.path(corpus_pipeline.MODEL))
    text = {r.doc_id: r.text for r in kept["secret_scan"]}
    assert {r.doc_id: r.ids for r in kept["sentencepiece"]} == {k: v.lib.encode(t) for k, t in text.items()}


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like results."""
    return docs.withColumns({"mask": F.lit(1), "keep_id": F.lit(2), "bad_id": F.lit(3), "spans": F.lit(4), "again": F.lit(5), "ids": F.lit(6)})


def test_stages_on_odd_rows(spark, odd, sf):
    rows = odd.collect()
    letters = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    stage = dict(corpus_pipeline.STAGES)
    columns = lambda d: tuple(d.columns) == corpus_pipeline.COLUMNS
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    one = stage["language_id"](spark, odd, sf)
    kept = one.collect()
    assert columns(one) and {key(r) for r in kept} <= {key(r) for r in letters} and all(r.lang for r in kept)
    two = stage["near_duplicates"](spark, odd, sf)
    got = [key(r) for r in two.collect()]
    want = brute_components([(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in rows], 5, 80)
    assert columns(two) and len(got) == len(set(got)) and {k[1] for k in got} == {0 if v == 1 << 62 else v for v in want.values()}
    three = stage["decontamination"](spark, odd, sf)
    assert columns(three) and sorted(map(key, three.collect())) == sorted(map(key, rows))
    four = stage["secret_scan"](spark, odd, sf)
    assert columns(four) and four.count() == len(rows) and {r.text or "" for r in four.collect()} <= {r.text or "" for r in rows} | {r.text for r in four.collect() if "[SECRET]" in r.text}
    five = stage["sentencepiece"](spark, odd, sf)
    v = sentencepieces.vocabulary(public_tokenizers.path(corpus_pipeline.MODEL))
    assert sorted(r.ids for r in five.collect()) == sorted(v.lib.encode(r.text or "") for r in rows)


def test_stages_on_nothing(spark, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_language_rejection(spark, docs, sf, monkeypatch):
    """Without labels all documents stay; with a model the least score decides, and prose of a learned language stays."""
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, plain, sf).count() == docs.count()
    table = read(spark, sf, "documents")
    scores = {r.doc_id: r.score for r in langid.identify(table, langid.fit(table)).collect() if r.lang_pred != langid.UNKNOWN}
    for least in (0.0, 0.7, 1.1):
        monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", least)
        assert {r.doc_id for r in corpus_pipeline.language_id(spark, table, sf).collect()} == {k for k, v in scores.items() if v >= least}
    assert min(scores.values()) >= 0.4 or sum(v >= 0.4 for v in scores.values()) >= 0.98 * len(scores)

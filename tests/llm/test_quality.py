"""Sketches of the quality rules: merging, error, and fences that follow a group's spread."""

import random

from pyspark.sql import functions as F

from geoloom.llm import quality


def test_bucket_keeps_six_bits(spark):
    values = [*range(200), *[2**k + d for k in range(7, 62) for d in (-1, 0, 1, 2 ** (k - 2))]]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b")).collect()
    for r in got:
        e = max(0, r.v.bit_length() - 6)
        assert r.b == r.v >> e << e and 0 <= r.v - r.b <= r.v / 32
    assert all(r.b == r.v for r in got if r.v < 64)


def test_sketches_merge_and_rank(spark):
    """Sketches of parts add up to the sketch of the whole, and its quantiles are the buckets of exact ones."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xyz"), 50 + rng.randrange(900), int(rng.paretovariate(1.2)) + 200, rng.randrange(30), rng.randrange(5), 60, int(rng.paretovariate(0.8)), False) for _ in range(3000)]
    m = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean")
    parts = [m.where(F.col("n_words") % 3 == k) for k in range(3)]
    several = quality.sketches(parts[0])
    for p in parts[1:]:
        several = several.unionByName(quality.sketches(p))
    key = lambda d: sorted(map(tuple, d.select("lang", "source", "metric", "bucket", "n").collect()))
    whole = quality.sketches(m)
    assert key(quality.merge_sketches(several, "lang", "source")) == key(whole)
    by_lang = quality.merge_sketches(whole, "lang")
    fences = {r.lang: r for r in quality.fences(by_lang, "lang").collect()}
    raw = m.select("lang", *[v.alias(k) for k, v in quality.metric_columns().items()]).collect()
    cut = lambda v: v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)
    for lang in "ab":
        for metric, both in quality.METRICS.items():
            v = sorted(r[metric] for r in raw if r.lang == lang)
            at = lambda tenth: cut(v[-(-len(v) * tenth // 10) - 1])  # noqa: B023, E731
            assert fences[lang][f"{metric}_hi"] == at(9) + quality.REACH * (at(9) - at(5))
            if both:
                assert fences[lang][f"{metric}_lo"] == at(1) - quality.REACH * (at(5) - at(1))


def _text(rng, symbols):
    words = [f"{rng.choice('bcdfghkl')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(symbols):
        words[k] += "#"
    return " ".join(words)


def test_tails_decide(spark):
    """Two sources of equal quartiles: the document with symbols is an outlier only where symbols are rare."""
    rng = random.Random(1)
    rows = []
    for source, tail in (("plain", 2), ("chatty", 24)):
        rows += [(len(rows) + k, _text(rng, 60 if k < tail else 0), "en", source) for k in range(100)]
    rows += [(1000, _text(rng, 60), "en", "plain"), (1001, _text(rng, 60), "en", "chatty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = quality.base_metrics(d).select("source", quality.metric_columns()["sym"].alias("v")).collect()
    quartile = lambda s, q: sorted(r.v for r in m if r.source == s)[int(q * 101)]
    assert all(quartile(s, q) == 0 for s in ("plain", "chatty") for q in (0.25, 0.5, 0.75))
    kept = {r.doc_id: r.kept for r in quality.quality_rules(d).collect()}
    assert not kept[1000] and kept[1001] and all(v for k, v in kept.items() if 2 <= k < 100 or 100 <= k < 200)

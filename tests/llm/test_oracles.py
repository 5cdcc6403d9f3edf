"""Queries with a DuckDB form, on the driver's table and on the odd one."""

import pytest

from pyspark.sql import functions as F

from geoloom.llm import jaccard, licenses, quality, repeats, secrets
from geoloom.llm.queries import ORACLES, QUERIES

RUN = {
    "op1_quality_rules": lambda d: quality.quality_rules(d),
    "op3_secret_scans": lambda d: secrets.digest(secrets.scan(d)),
    "op4_suffix_dedup": lambda d: repeats.remove(d).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")),
    "op5_ngram_jaccard": lambda d: jaccard.similar_components(d, size=4, percent=85),
    "op7_license_scans": lambda d: licenses.scan(d),
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_table(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(RUN))
def test_odd(name, docs, empty, same):
    import duckdb

    con = duckdb.connect()
    table = docs.toArrow()
    con.register("documents", table)
    same(RUN[name](docs), con.execute(ORACLES[name]))
    assert RUN[name](empty).count() == 0


def test_secret_rules(spark):
    key = "0123456789abcdef" * 3
    texts = [f'Password: "{key[:12]}" and AKIA{"A1" * 8} {key}', "token=secret:abcdefghij", "😀 api_key = 'zzzzzzzz'", "AKIA" + "AKIA" * 4, "ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", "token=" + "b" * 7]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(d)).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 1, 1) and rows[1].n_assign == 0 and rows[5].spans == ""
    assert rows[2].spans == "assign:2:21" and rows[3].n_access == 1 and "github" in rows[4].spans and "pem" in rows[4].spans
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(d)).collect()}
    assert key not in clean[0] and clean[5] == texts[5] and clean[2] == "😀 [SECRET]'"


def test_trigrams_are_necessary():
    import re

    from geoloom.llm.trigrams import query

    for rule, text in (("(foo|bar)baz+", "xbarbazz"), ("ab?cd(ef)?gh", "acdgh"), ("[xy]yz.*tail", "yyz--tail"), ("(?:one|two){2,}end", "twooneend")):
        q = query(rule)
        assert re.search(rule, text) and q and any(all(t in text for t in s) for s in q)
    assert query("[0-9a-f]+") is None and query("a?b?") is None


def test_license_texts(spark):
    from geoloom.llm.licenses import KNOWN, canonical, canonical_text

    texts = [t for _, t in KNOWN] + ["MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + KNOWN[0][1].upper(), "foo\nReleased under the MIT licence!\nbar"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0] for r in d.orderBy("doc_id").select(canonical(d.text)).collect()] == [canonical_text(t) for t in texts]
    rows = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert [rows[k].license for k in range(len(KNOWN))] == [i for i, _ in KNOWN]
    assert rows[len(KNOWN)].license == "MIT" and rows[len(KNOWN) + 1].license is None and rows[len(KNOWN) + 1].statements == "MIT"

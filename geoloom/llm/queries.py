"""The ``op*`` queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard, langid, licenses, quality, repeats, secrets, sentencepieces, tokenfiles, toxicity
from geoloom.llm.common import held_out, materialize, read


def op1_quality_rules(spark, sf_dir):
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(materialize(toxicity.training_rows(docs, read(spark, sf_dir, "labels"))))
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.score(d, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scans(spark, sf_dir):
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark, sf_dir):
    d = repeats.remove(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_components(read(spark, sf_dir, "documents"), size=4, percent=85)


def op6_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs)
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(d, model).select("doc_id", "held_out", "lang_pred", "score")


def op7_license_scans(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.digest(sentencepieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")))


def op10_token_files(spark, sf_dir):
    return tokenfiles.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scans": op3_secret_scans,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_license_scans": op7_license_scans,
    "op8_decontamination": op8_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_files": op10_token_files,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op3_secret_scans": secrets.oracle_sql(),
    "op4_suffix_dedup": repeats.ORACLE,
    "op5_ngram_jaccard": jaccard.ORACLE,
    "op7_license_scans": licenses.oracle_sql(),
}

"""A corpus pipeline of five stages over ``documents``.

Every stage works on all that its predecessor kept and returns the columns of
``documents``, except the last, which returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard, langid, secrets, sentencepieces
from geoloom.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = "piece_bpe_32k.model"
#: Share of the probability that a document's language must have.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the learned languages; a missing label is filled with the prediction.

    Rejected are texts without a letter and those whose predicted language has
    less than LEAST_SCORE of the probability over the whole text.  Without any
    labelled document there is nothing to predict, and all stay.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.select(*COLUMNS)
    d = langid.identify(docs.select(*COLUMNS), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return d.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group linked at 0.8 on five-word shingles."""
    return jaccard.one_of_each(docs, size=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item at an edit similarity of 0.8 or more."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` follows the new text."""
    d = secrets.redact(secrets.scan(docs, keep=("lang", "source")))
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: doc_id, lang, source, n_tokens, ids, and digests of ids and decoded text."""
    d = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL))
    return d.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]
#: No stage but the secret scan can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import materialize, shared_dir

__all__ = ["crc32_mod5", "held_out", "materialize", "read", "shared_dir", "small_batches"]

#: Rows of one Arrow batch; texts of some thousand bytes make a few MB of it, in the JVM and in Python.
BATCH_ROWS = 2000
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", 10_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, unless it has a setting of its own."""
    if int(spark.conf.get(_KEY)) == _DEFAULT:
        spark.conf.set(_KEY, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod5(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True for rows kept out of every fit (remainder 0); false for a null id."""
    return F.coalesce(crc32_mod5(doc_id) == 0, F.lit(False))

"""Lookup joins against caches and side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import text


def address_lookup(d: DataFrame, cache: DataFrame, address: str, result: str = "result") -> DataFrame:
    """``d`` with ``was_asked`` and ``result``.

    The cache (key, result) tells three cases apart: no row was never asked, a
    null result was asked and not found, a value was found.  The join is left to
    the optimizer, which broadcasts the cache only while it is small.
    """
    c = cache.select(F.col("key").alias("_key"), F.lit(True).alias("_asked"), F.col("result").alias(result))
    j = d.withColumn("_k", text.cache_key(F.col(address))).join(c, F.col("_k") == F.col("_key"), "left")
    return j.withColumn("was_asked", F.coalesce("_asked", F.lit(False))).drop("_k", "_key", "_asked")


def addresses_to_geocode(d: DataFrame, cache: DataFrame, address: str) -> DataFrame:
    """Distinct addresses that were never asked, with the texts to try in order."""
    a = d.where(text.clean_text(F.col(address)).isNotNull()).select(F.col(address).alias("address")).distinct()
    missing = a.join(cache.select(F.col("key").alias("_key")), text.cache_key(F.col("address")) == F.col("_key"), "left_anti")
    return missing.select("address", text.cache_key(F.col("address")).alias("key"))


def with_url(rollup: DataFrame, urls: DataFrame) -> DataFrame:
    """An operator rollup with a curated (operator, url, note) table, left joined."""
    return rollup.join(urls, "operator", "left").withColumn("note", F.coalesce("note", F.lit("")))

"""Data-quality gates: what is refused, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo


def rejection(lat: Column, lng: Column) -> Column:
    """Reason to reject a coordinate, or null."""
    return F.when(~geo.is_valid(lat, lng), "missing or invalid coordinates").when(~geo.in_country(lat, lng), F.concat(F.lit("coordinate outside the country ("), lat.cast("string"), F.lit(","), lng.cast("string"), F.lit(")")))


def split_rejected(d: DataFrame, source_id: str = "source_id", record_id: str = "source_record_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a usable coordinate, one ``rejected`` issue for each other row)."""
    r = d.withColumn("_why", rejection(F.col("lat"), F.col("lng")))
    issues = r.where(F.col("_why").isNotNull()).select(F.col(source_id).alias("source_id"), F.col(record_id).cast("string").alias("source_record_id"), F.lit("rejected").alias("kind"), F.col("_why").alias("issue"))
    return r.where(F.col("_why").isNull()).drop("_why"), issues


def within(d: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return d.where(geo.in_box(F.col("lat"), F.col("lng"), box))


def too_old(base: Column, now: Column, days: float = 7) -> Column:
    """Whether data of time ``base`` is more than ``days`` (fractional) old at ``now``."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(base.cast("timestamp"))) / 86_400_000_000 > days


def totals_match(rows: DataFrame, sums: dict[str, Column], stated: dict[str, float | None]) -> str | None:
    """None if the sums over ``rows`` equal what the page states of itself, else why not."""
    got = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]).first().asDict()
    for k, v in got.items():
        if stated.get(k) is None:
            return f"no stated total for {k}"
        if v != stated[k]:
            return f"parsed {k} {v} does not match the stated {stated[k]}"
    return None


def expect_columns(d: DataFrame, *columns: str) -> str | None:
    missing = [c for c in columns if c not in d.columns]
    return f"missing columns: {', '.join(missing)}" if missing else None


def expect_rows(d: DataFrame, least: int = 1) -> str | None:
    """Reads at most ``least`` rows, and no column: what only works out values, windows too, is left out of the plan."""
    return None if len(d.select(F.lit(1)).take(least)) >= least else f"fewer than {least} rows"

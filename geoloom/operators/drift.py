"""Run-over-run comparison, freshness and incremental differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days after which a field's value counts as old.
FRESHNESS_DAYS = {
    "lat": 3650, "lng": 3650, "name": 365, "operator": 180, "network": 180, "address": 730, "connectors": 180,
    "plug_count": 180, "max_power_kw": 180, "status": 30, "access": 180, "fee": 30, "opening_hours": 90, "website": 365,
}


@dataclass(frozen=True)
class DriftLimits:
    count_warn: float = 0.10
    count_fail: float = 0.35
    rise_warn: float = 0.10
    rise_fail: float = 0.25
    rate_fail: float = 0.75
    fail_on_zero: bool = True


def _opt(d: DataFrame, alias: str, name: str, kind: str) -> Column:
    return F.col(f"{alias}.{name}") if name in d.columns else F.lit(None).cast(kind)


def detect(previous: DataFrame, current: DataFrame, limits: DriftLimits = DriftLimits()) -> DataFrame:  # noqa: B008
    """(source_id, level, message) findings of a run against the one before, one left join on the source.

    Columns: source_id, record_count, issue_rate and, if there, structural_issue_rate,
    error, skipped, served_from, stale_fallback.
    """
    c, p = current.alias("c"), previous.withColumn("_known", F.lit(True)).alias("p")
    j = c.join(p, F.col("c.source_id") == F.col("p.source_id"), "left")
    cur, prev = lambda n, k: _opt(current, "c", n, k), lambda n, k: _opt(previous, "p", n, k)
    rate = F.coalesce(cur("structural_issue_rate", "double"), cur("issue_rate", "double"))
    before = F.coalesce(prev("structural_issue_rate", "double"), prev("issue_rate", "double"))
    rise = rate - before
    count, old = cur("record_count", "long"), prev("record_count", "long")
    delta = (count - old) / F.when(old > 0, old)
    pct = lambda x: F.format_string("%.1f", x * 100)
    say = lambda level, *parts: F.struct(F.lit(level).alias("level"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("message"))
    n, m = count.cast("string"), old.cast("string")
    ends = (
        F.when(cur("error", "string").isNotNull() & (cur("error", "string") != ""), say("fail", "fetch/normalise error: ", cur("error", "string")))
        .when(F.coalesce(cur("skipped", "boolean"), F.lit(False)), say("ok", "skipped (not configured)"))
        .when(F.lit(limits.fail_on_zero) & (count == 0), say("fail", "returned zero records"))
    )
    found = F.array_compact(F.array(
        F.when(rate >= limits.rate_fail, say("fail", pct(rate), "% of records failed to parse"))
        .when(rise >= limits.rise_fail, say("fail", "parse-failure rate rose ", pct(rise), " points"))
        .when(rise >= limits.rise_warn, say("warn", "parse-failure rate rose ", pct(rise), " points")),
        F.when(F.coalesce(cur("stale_fallback", "boolean"), F.lit(False)), say("warn", "served from a stale local cache")),
        F.when(prev("served_from", "string") != cur("served_from", "string"), say("warn", "served from a different endpoint than last run")),
        F.when(F.abs(delta) >= limits.count_fail, say("fail", "record count moved ", pct(delta), "% (", m, " -> ", n, ")"))
        .when(F.abs(delta) >= limits.count_warn, say("warn", "record count moved ", pct(delta), "% (", m, " -> ", n, ")"))
        .when(F.col("p._known").isNull(), say("ok", "new source, baseline ", n, " records")),
    ))
    calm = F.array(say("ok", n, " records, ", pct(F.coalesce(rate, F.lit(0.0))), "% parse-failure rate"))
    all_ = F.when(ends.isNotNull(), F.array(ends)).when(F.size(found) > 0, found).otherwise(calm)
    return j.select(F.col("c.source_id").alias("source_id"), F.explode(all_).alias("f")).select("source_id", "f.level", "f.message")


def worst(findings: DataFrame) -> str:
    """ok, warn or fail."""
    order = F.when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0)
    return ("ok", "warn", "fail")[findings.agg(F.max(order)).first()[0] or 0]


def promote_baseline(current: DataFrame, findings: DataFrame, path: str) -> bool:
    """Write the run as the new baseline unless it failed."""
    if worst(findings) == "fail":
        return False
    current.write.mode("overwrite").parquet(path)
    return True


def staleness(fetched_at: Column, field: str, as_of: Column, budgets: dict[str, int] = FRESHNESS_DAYS) -> Column:
    """struct<age_days, budget_days, stale>; null without a fetch time or a budget."""
    budget = budgets.get(field)
    if not budget:
        return F.lit(None).cast("struct<age_days:double,budget_days:int,stale:boolean>")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(fetched_at.cast("timestamp"))) / 86_400_000_000
    return F.when(age.isNotNull(), F.struct(F.round(age, 2).alias("age_days"), F.lit(budget).alias("budget_days"), (age > budget).alias("stale")))


def provenance_staleness(sites: DataFrame, as_of: Column, budgets: dict[str, int] = FRESHNESS_DAYS) -> DataFrame:
    """(id, field, age_days, budget_days, stale) of every field with provenance; the budget table is a fixed dozen rows."""
    table = sites.sparkSession.createDataFrame(sorted(budgets.items()), "field string, budget_days int")
    d = sites.select("id", F.explode("provenance").alias("field", "p")).join(F.broadcast(table), "field")
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("p.fetched_at").cast("timestamp"))) / 86_400_000_000
    return d.where(age.isNotNull()).select("id", "field", F.round(age, 2).alias("age_days"), "budget_days", (age > F.col("budget_days")).alias("stale"))


def changed(previous: DataFrame, current: DataFrame, key: str, digest: Column | None = None) -> DataFrame:
    """(key, change): appeared, disappeared or, given a digest column present on both sides, changed."""
    p, c = previous.select(key, *([digest.alias("_d")] if digest is not None else [])).alias("p"), current.select(key, *([digest.alias("_d")] if digest is not None else [])).alias("c")
    gone = p.join(c, key, "left_anti").select(key, F.lit("disappeared").alias("change"))
    new = c.join(p, key, "left_anti").select(key, F.lit("appeared").alias("change"))
    out = gone.unionByName(new)
    if digest is not None:
        both = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}")).where(~F.col("p._d").eqNullSafe(F.col("c._d")))
        out = out.unionByName(both.select(F.col(f"p.{key}").alias(key), F.lit("changed").alias("change")))
    return out


def manifest_update(previous: DataFrame, fetched: DataFrame) -> DataFrame:
    """Manifest rows (key, url, fetched_at, sha256, bytes) with what they were before and whether the content changed."""
    p = previous.select("key", F.col("sha256").alias("previous_sha256"), F.col("bytes").alias("previous_bytes"))
    return fetched.join(p, "key", "left").withColumn("changed", F.col("previous_sha256").isNotNull() & (F.col("previous_sha256") != F.col("sha256")))

"""Coverage, rollups, map clusters and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.schema import STRUCTURAL


def _precision(d: DataFrame) -> Column:
    p = F.col("position_precision") if "position_precision" in d.columns else F.lit(None).cast("string")
    g = F.col("geocoded") if "geocoded" in d.columns else F.lit(False)
    return text.position_precision(p, g)


def coverage_totals(sites: DataFrame) -> DataFrame:
    """One row: sites, mappable, approximate, plugs and completeness ratios (4 places)."""
    has = {c for c in ("name", "max_power_kw", "connectors", "plug_count") if c in sites.columns}
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda cond: F.round(F.count_if(cond) / n, 4)
    return sites.agg(
        F.count("*").alias("sites"), F.count_if(text.is_mappable(_precision(sites))).alias("mappable_sites"), F.count_if(~text.is_mappable(_precision(sites))).alias("approximate_sites"),
        F.coalesce(F.sum("plug_count") if "plug_count" in has else F.lit(0), F.lit(0)).cast("long").alias("plugs"),
        share(F.coalesce(F.col("name"), F.lit("")) != "").alias("with_name"), share(F.coalesce(F.col("max_power_kw"), F.lit(0.0)) != 0).alias("with_power"),
        (share(F.size("connectors") > 0) if "connectors" in has else F.lit(0.0)).alias("with_connectors"),
    )


def coverage_counts(sites: DataFrame) -> DataFrame:
    """(dimension, value, n) by state, precision, operator, speed band, status and source count in one grouping-sets pass."""
    dims = {
        "state": F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit("unknown")), "precision": _precision(sites), "operator": F.coalesce(F.nullif(F.col("operator"), F.lit("")), F.lit("unknown")),
        "speed_band": F.col("speed_band"), "status": F.col("status"), "source_count": F.col("source_count").cast("string"),
    }
    d = sites.select(*[v.alias(k) for k, v in dims.items()])
    cols = list(dims)
    g = d.groupingSets([[F.col(c)] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    bit = {(1 << len(cols)) - 1 - (1 << (len(cols) - 1 - k)): c for k, c in enumerate(cols)}
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, c in bit.items():
        dim = F.when(F.col("gid") == gid, c).otherwise(dim)
        value = F.when(F.col("gid") == gid, F.col(c)).otherwise(value)
    return g.select(dim.alias("dimension"), value.alias("value"), "n")


def top_operators(sites: DataFrame, n: int = 20) -> DataFrame:
    """The n operators with the most sites."""
    d = sites.groupBy(F.coalesce(F.nullif(F.col("operator"), F.lit("")), F.lit("unknown")).alias("operator")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "operator").limit(n)


def operator_options(sites: DataFrame, n: int = 40) -> DataFrame:
    """The n most frequent operators, in alphabetical order."""
    d = sites.where(F.coalesce(F.col("operator"), F.lit("")) != "").groupBy("operator").agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "operator").limit(n).orderBy("operator")


def operator_rollup(sites: DataFrame, listed_from: int = 5) -> DataFrame:
    """Per operator: sites, mappable, approximate, plugs, plug_coverage, max_kw, dc and ac sites, states, planned, listed."""
    mappable = text.is_mappable(_precision(sites))
    uses = lambda *names: F.coalesce(F.exists("connectors", lambda c: c["standard"].isin(*names)), F.lit(False)) if "connectors" in sites.columns else F.lit(False)
    dc, ac = uses("CCS2", "CHAdeMO", "DCUnspecified", "TeslaProprietary"), uses("Type2", "Type1", "ACUnspecified")
    plugs = F.col("plug_count") if "plug_count" in sites.columns else F.lit(None).cast("int")
    d = sites.groupBy(F.coalesce(F.nullif(F.col("operator"), F.lit("")), F.lit("(unattributed)")).alias("operator")).agg(
        F.count("*").alias("sites"), F.count_if(mappable).alias("mappable"), F.count_if(~mappable).alias("approximate"), F.coalesce(F.sum(plugs), F.lit(0)).cast("long").alias("plugs"),
        (F.count(plugs) / F.count("*")).alias("plug_coverage"), F.nullif(F.max("max_power_kw"), F.lit(0.0)).alias("max_kw"), F.count_if(dc).alias("dc_sites"),
        F.count_if(ac).alias("ac_sites"), F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"), F.count_if(F.col("status") == "planned").alias("planned"),
    )
    return d.withColumn("listed", F.col("sites") >= listed_from)


def map_clusters(sites: DataFrame, zoom: int, center_lat: float, pixels: int = 70) -> DataFrame:
    """Grid cells of a map view (gy, gx): count and the site of the largest power, the smallest id at ties."""
    cell_m = geo.metres_per_pixel(center_lat, zoom) * pixels
    row, col = geo.cell(F.col("lat"), F.col("lng"), cell_m)
    best = F.min_by("id", F.struct(-F.coalesce(F.col("max_power_kw"), F.lit(0.0)), F.col("id")))
    return sites.groupBy(row.alias("gy"), col.alias("gx")).agg(F.count("*").alias("n"), best.alias("best_id"))


def centroid(sites: DataFrame, *keys: str) -> DataFrame:
    return sites.groupBy(*keys).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))


def latest_fetch(sources: Column) -> Column:
    return F.array_max(F.transform(sources, lambda s: s["fetched_at"]))


def source_stats(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Per source: record, issue and structural counts with rates (4 places), histogram of issue kinds, planned records."""
    r = records.groupBy("source_id").agg(F.count("*").alias("record_count"), F.count_if(F.col("status") == "planned").alias("planned_count"))
    kinds = issues.groupBy("source_id", "kind").agg(F.count("*").alias("n"))
    i = kinds.groupBy("source_id").agg(
        F.sum("n").alias("issue_count"), F.coalesce(F.sum(F.when(F.col("kind").isin(*STRUCTURAL), F.col("n"))), F.lit(0)).alias("structural_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("issue_kinds"),
    )
    d = r.join(i, "source_id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: F.when(z("record_count") > 0, F.round(z(c) / F.col("record_count"), 4)).otherwise(0.0)
    return d.select("source_id", z("record_count").alias("record_count"), z("planned_count").alias("planned_count"), z("issue_count").alias("issue_count"), rate("issue_count").alias("issue_rate"), z("structural_count").alias("structural_count"), rate("structural_count").alias("structural_issue_rate"), "issue_kinds")


def issue_summary(issues: DataFrame) -> DataFrame:
    """(issue, n): messages by source with their variable parts masked."""
    return issues.groupBy(F.concat_ws(": ", "source_id", text.issue_shape(F.col("issue"))).alias("issue")).agg(F.count("*").alias("n"))


def geocode_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count("result").alias("resolved"), F.count_if(F.col("result").isNull()).alias("unresolved"))


def preceding_label(d: DataFrame, key: str, order: str, label: Column, window: int | None = None, out: str = "label") -> DataFrame:
    """The last non-null label before each row in the order of its key, at most ``window`` positions back."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_l", F.last(F.when(label.isNotNull(), F.struct(label.alias("v"), F.col(order).alias("at"))), ignorenulls=True).over(w))
    near = F.lit(True) if window is None else (F.col(order) - F.col("_l.at") <= window)
    return d.withColumn(out, F.when(near, F.col("_l.v"))).drop("_l")


def operator_summary(rollup: DataFrame) -> DataFrame:
    """One row over the rollup: totals of all, of the listed operators and of the tail."""
    part = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    listed = F.col("listed")
    return rollup.agg(
        F.sum("sites").alias("total_sites"), F.sum("mappable").alias("mappable_sites"), F.sum("approximate").alias("approximate_sites"), F.sum("plugs").alias("total_plugs"), F.count("*").alias("operators"),
        F.count_if(listed).alias("listed_count"), part("sites", listed).alias("listed_sites"), F.count_if(~listed).alias("tail_count"), part("sites", ~listed).alias("tail_sites"), part("plugs", ~listed).alias("tail_plugs"), F.count_if(F.col("sites") == 1).alias("single_site_operators"),
    )


def operator_table(sites: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary row, operators with their links, the largest first): the two parts of the operator table."""
    from geoloom.operators.lookup import with_url

    rows = with_url(operator_rollup(sites), urls)
    links = rows.agg(F.count_if(F.col("listed") & F.col("url").isNotNull()).alias("with_url"))
    return operator_summary(rows).crossJoin(F.broadcast(links)), rows.orderBy(F.desc("sites"), "operator")


def speed_class(precision: Column, status: Column, band: Column) -> Column:
    """How a map shows a site: approximate before planned before its speed band."""
    return F.when(precision == text.BY_LOCALITY, "approximate").when(status == "planned", "planned").otherwise(F.coalesce(F.nullif(band, F.lit("")), F.lit("unknown")))


def dataset_counts(records: DataFrame, sites: DataFrame, resolution: DataFrame) -> DataFrame:
    """One row: the counts of the resolution with source records, all sites and planned ones."""
    r = records.agg(F.count("*").alias("source_records"))
    s = sites.agg(F.count("*").alias("sites_including_planned"), F.count_if(F.col("status") == "planned").alias("planned_sites"))
    # three tables of one row each
    return resolution.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(s))


#: Speed bands in the order of a report.
BAND_ORDER = ("ultra", "rapid", "fast", "medium", "slow", "trickle", "unknown")


def report_order(counts: DataFrame) -> DataFrame:
    """(dimension, value, n) in the order of a report: bands from fast to slow, everything else by count."""
    band = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in BAND_ORDER]), F.col("value")), F.lit(99))
    return counts.orderBy("dimension", F.when(F.col("dimension") == "speed_band", band).otherwise(0), F.desc("n"), "value")

"""Spatial entity resolution: block, score, cluster, merge with provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.operators.components import connected_components
from geoloom.schema import RECORD, conform

# Most trusted source first, per field.
FIELD_TRUST = {
    "name": ("osm", "act", "vic", "nsw", "qld", "tas"),
    "operator": ("nsw", "vic", "qld", "osm", "tas"),
    "network": ("nsw", "vic", "osm", "qld"),
    "position": ("osm", "nsw", "vic", "qld", "act", "tas"),
    "address": ("act", "nsw", "vic", "qld", "osm", "tas"),
    "plug_count": ("act", "vic", "nsw", "osm", "qld"),
    "max_power_kw": ("vic", "act", "nsw", "osm", "qld"),
    "status": ("nsw", "qld", "vic", "osm", "act", "tas"),
    "access": ("osm", "act", "nsw", "vic", "qld"),
    "fee": ("osm", "nsw", "vic", "qld", "act"),
    "opening_hours": ("osm", "nsw", "vic", "qld"),
    "website": ("osm", "nsw", "vic", "qld"),
}
SCALARS = ("name", "operator", "network", "status", "access", "fee", "opening_hours", "website", "plug_count", "max_power_kw", "address")


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds of pair scoring."""

    max_distance_m: float = 250.0
    certain_distance_m: float = 30.0
    cell_m: float = 250.0
    threshold: float = 0.55
    name_agree: float = 0.5
    name_conflict: float = 0.12
    #: Search columns by a step fixed for each grid row, so that neighbours to
    #: the north and south are never missed; off by default for parity.
    strict_blocking: bool = False
    #: Take longitudes that run on past 180 degrees; else they are rejected, as in the reference.
    any_turn: bool = False
    trust: dict = field(default_factory=lambda: dict(FIELD_TRUST), compare=False)


def usable(records: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    return records.where(geo.is_valid(F.col("lat"), F.col("lng"), cfg.any_turn))


def _cells(d: DataFrame, cfg: MatchConfig) -> DataFrame:
    row, col = geo.cell(F.col("lat"), F.col("lng"), cfg.cell_m)
    return d.withColumn("gy", row).withColumn("gx", col)


def prepared(records: DataFrame) -> DataFrame:
    """What scoring needs of a record, worked out once a record and not once a pair."""
    have = set(records.columns)
    c = lambda n, k="string": F.col(n) if n in have else F.lit(None).cast(k)
    name, op = F.nullif(c("name"), F.lit("")), F.nullif(c("operator"), F.lit(""))
    venue = name.isNotNull() & ~F.coalesce(c("name_from_operator", "boolean"), F.lit(False)) & F.coalesce(text.operator_key(name) != F.when(op.isNotNull(), text.operator_key(op)), F.lit(True))
    post = F.col("address.postcode") if "address" in have else F.lit(None).cast("string")
    return records.select(
        "rid", "lat", "lng", op.alias("operator"), name.isNotNull().alias("named"), text.name_tokens(name).alias("tokens"), F.coalesce(venue, F.lit(False)).alias("venue"),
        text.position_precision(c("position_precision"), c("geocoded", "boolean")).alias("precision"), post.alias("postcode"),
    )


def candidate_pairs(records: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """(a, b) structs of records whose grid cells touch, each pair once with a.rid < b.rid.

    The neighbourhood of the record with the smaller rid is exploded and joined
    by equality on the cell, so the plan is a hash or sort-merge join that
    adaptive execution can split, never a nested loop.
    """
    r = prepared(records)
    cols = r.columns
    near = F.sequence(F.lit(-1), F.lit(1))
    if cfg.strict_blocking:
        step = geo.lat_step(cfg.cell_m)
        row = F.floor(F.col("lat") / step).cast("long")
        # the widest step within the row, at its end nearer to a pole
        at = lambda y: F.floor(F.col("lng") / geo.lng_step(F.greatest(F.abs(y * step), F.abs((y + 1) * step)), cfg.cell_m)).cast("long")
        right = r.select(F.struct(*cols).alias("b"), row.alias("gy"), at(row).alias("gx"))
        left = r.select(F.struct(*cols).alias("a"), F.col("lng"), (row).alias("y")).withColumn("gy", F.explode(F.transform(near, lambda d: F.col("y") + d)))
        left = left.withColumn("x", at(F.col("gy"))).select("a", "gy", F.explode(F.transform(near, lambda d: F.col("x") + d)).alias("gx"))
    else:
        c = _cells(r, cfg)
        right = c.select(F.struct(*cols).alias("b"), "gy", "gx")
        left = c.select(F.struct(*cols).alias("a"), F.explode(F.transform(near, lambda d: F.col("gy") + d)).alias("gy"), "gx")
        left = left.select("a", "gy", F.explode(F.transform(near, lambda d: F.col("gx") + d)).alias("gx"))
    return left.join(right, ["gy", "gx"]).where(F.col("a.rid") < F.col("b.rid")).select("a", "b")


def score_pairs(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """rid_a, rid_b, distance_m, score and reasons of every pair."""
    a, b = F.col("a"), F.col("b")
    both = F.size(F.array_union(a["tokens"], b["tokens"]))
    same = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    likeness = F.when((F.size(a["tokens"]) == 0) | (F.size(b["tokens"]) == 0), 0.0).otherwise(same / F.greatest(both, F.lit(1)))
    d = pairs.select("a", "b", geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]).alias("distance_m"), F.when(a["named"] & b["named"], likeness).alias("_sim"))
    dist, sim, venues = F.col("distance_m"), F.col("_sim"), a["venue"] & b["venue"]
    local = (a["precision"] == text.BY_LOCALITY) | (b["precision"] == text.BY_LOCALITY)
    both_derived = (a["precision"] != text.SURVEYED) & (b["precision"] != text.SURVEYED) & (F.coalesce(sim, F.lit(0.0)) < cfg.name_agree)
    op_same, op_diff = F.coalesce(a["operator"] == b["operator"], F.lit(False)), F.coalesce(a["operator"] != b["operator"], F.lit(False))
    name_same = venues & F.coalesce(sim >= cfg.name_agree, F.lit(False))
    name_diff = venues & F.coalesce(sim <= cfg.name_conflict, F.lit(False)) & ~name_same
    post = F.coalesce(a["postcode"] == b["postcode"], F.lit(False))
    total = (
        (1 - dist / cfg.max_distance_m) * 0.6 + F.when(op_same, 0.25).when(op_diff, -0.3).otherwise(0.0)
        + F.when(name_same, 0.2 * sim).when(name_diff, -0.15).otherwise(0.0) + F.when(post, 0.05).otherwise(0.0)
    )
    certain = (dist <= cfg.certain_distance_m) & ~op_diff & ~(venues & F.coalesce(sim <= cfg.name_conflict, F.lit(False)))
    total = F.when(certain, F.greatest(total, F.lit(0.8))).otherwise(total)
    zero = local | (dist > cfg.max_distance_m) | both_derived
    score = F.when(zero, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    two = lambda x: F.format_string("%.2f", x)
    reasons = (
        F.when(local, F.array(F.lit("one side is known to town level only")))
        .when(dist > cfg.max_distance_m, F.array(F.lit("beyond max distance")))
        .when(both_derived, F.array(F.lit("both positions are geocoded and names disagree")))
        .otherwise(F.array_compact(F.array(
            F.format_string("distance %.0fm (+%.2f)", dist, (1 - dist / cfg.max_distance_m) * 0.6),
            F.when(op_same, F.lit("operator match (+0.25)")).when(op_diff, F.lit("operator conflict (-0.30)")),
            F.when(name_same, F.concat(F.lit("name sim "), two(sim))).when(name_diff, F.lit("name conflict (-0.15)")),
            F.when(post, F.lit("postcode match (+0.05)")),
            F.when(certain, F.lit("close by without conflict (floor 0.80)")),
        )))
    )
    return d.select(a["rid"].alias("rid_a"), b["rid"].alias("rid_b"), "distance_m", score.alias("score"), reasons.alias("reasons"))


def links(scored: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    return scored.where(F.col("score") >= cfg.threshold)


def clusters(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """rid, cluster_id for every record: the smallest rid that it is linked to, directly or not."""
    c = connected_components(accepted.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
    r = records.select("rid")
    return r.join(c, r.rid == c.node, "left").select("rid", F.coalesce("component", "rid").alias("cluster_id"))


def trust_rank(field_name: str, cfg: MatchConfig) -> Column:
    order = cfg.trust.get(field_name, ())
    out = F.lit(len(order) + 1)
    for k, s in reversed(list(enumerate(order))):
        out = F.when(F.col("source_id") == s, k).otherwise(out)
    return out


def _pick(name: str, value: Column, cfg: MatchConfig, length: Column | None = None) -> Column:
    """The value of the most trusted source that has one, with its provenance: an aggregate struct.

    Ties go to the later fetch, the longer value and the smaller rid; an unknown
    fetch time counts as the earliest.
    """
    has = value.isNotNull() & (F.coalesce(value.cast("string"), F.lit("")) != "") if name not in ("address", "position") else value.isNotNull()
    n = length if length is not None else F.length(value.cast("string"))
    key = F.struct(trust_rank(name, cfg), -F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-(2**62))), -n, F.col("rid"))
    what = F.struct(value.alias("value"), F.col("source_id").alias("source_id"), F.col("source_record_id").alias("source_record_id"), F.col("fetched_at").alias("fetched_at"))
    return F.min_by(F.when(has, what), F.when(has, key)).alias(f"p_{name}")


def trust_pick(members: DataFrame, field_name: str, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """cluster_id, value, source_id of one field."""
    d = members.groupBy("cluster_id").agg(_pick(field_name, F.col(field_name), cfg).alias("p"))
    return d.select("cluster_id", F.col("p.value").alias("value"), F.col("p.source_id").alias("source_id"))


def _told_connectors() -> Column:
    """The connectors of a record with its source."""
    return F.transform(F.coalesce("connectors", F.array().cast(RECORD["connectors"])), lambda c: F.struct(c["standard"].alias("standard"), c["count"].alias("count"), c["power_kw"].alias("power_kw"), F.col("source_id").alias("source_id")))


def _collected() -> Column:
    """All connectors of a group's records, in the order of the records: an aggregate."""
    return F.flatten(F.array_sort(F.collect_list(F.struct("rid", _told_connectors().alias("c")))).getField("c"))


def _by_standard(all_: Column) -> Column:
    """One connector a standard: its largest power and count, and the sources that name it; the strongest first."""

    def one(s: Column) -> Column:
        own = F.filter(all_, lambda c: c["standard"] == s)
        return F.struct(
            F.nullif(F.array_max(F.transform(own, lambda c: c["power_kw"])), F.lit(0.0)).alias("power_kw"), s.alias("standard"),
            F.nullif(F.array_max(F.transform(own, lambda c: c["count"])), F.lit(0)).alias("count"), F.array_distinct(F.transform(own, lambda c: c["source_id"])).alias("sources"),
        )

    power = lambda x: F.coalesce(x["power_kw"], F.lit(0.0))
    standards = F.array_distinct(F.transform(all_, lambda c: c["standard"]))
    return F.array_sort(F.transform(standards, one), lambda x, y: F.when(power(x) > power(y), -1).when(power(x) < power(y), 1).otherwise(0))


def connector_merge(d: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, standard, count, power_kw, sources): the connectors of each group as ``merge`` gives them."""
    g = d.groupBy(key).agg(_collected().alias("_connectors"))
    return g.select(key, F.explode(_by_standard(F.col("_connectors"))).alias("c")).select(key, "c.standard", "c.count", "c.power_kw", "c.sources")


def slug_id(lat: Column, lng: Column, operator: Column) -> Column:
    """Stable id of a place: rounded position and operator."""
    part = lambda x: F.replace(F.replace(F.format_string("%.4f", x), F.lit("-"), F.lit("s")), F.lit("."), F.lit(""))
    key = F.coalesce(F.nullif(text.slug(F.coalesce(F.nullif(operator, F.lit("")), F.lit("unknown")), 14), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("au-"), part(lat), F.lit("-"), F.replace(F.format_string("%.4f", lng), F.lit("."), F.lit("")), F.lit("-"), key)


def number_collisions(d: DataFrame, id_col: str = "id", tie: str = "cluster_id") -> DataFrame:
    """The second row of an id gets -2, the third -3, in the order of ``tie``."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(tie))
    return d.withColumn("_n", n).withColumn(id_col, F.when(F.col("_n") > 1, F.concat(F.col(id_col), F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(id_col))).drop("_n")


def spread_m(points: Column) -> Column:
    """Largest distance between any two of an array of (lat, lng) structs."""
    far = F.transform(points, lambda p: F.array_max(F.transform(points, lambda q: geo.haversine_m(p["lat"], p["lng"], q["lat"], q["lng"]))))
    return F.coalesce(F.array_max(far), F.lit(0.0))


def merge(records: DataFrame, membership: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """One site per cluster in one aggregation: picked fields, provenance, conflicts, derived columns."""
    m = conform(records).join(membership, "rid")
    picks = [_pick(f, F.col(f), cfg, F.lit(15) if f == "address" else None) for f in SCALARS]
    # the position is picked as one value, so both coordinates come from one record
    picks.append(_pick("position", F.struct("lat", "lng"), cfg, F.lit(1)))
    told = lambda f: F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"})
    values = F.struct(F.col("rid"), F.col("source_id"), *[F.when(F.col(f).isNotNull() & (F.coalesce(F.col(f).cast("string"), F.lit("")) != "" if f != "address" else F.lit(True)), told(f)).alias(f) for f in SCALARS])
    precision = text.position_precision(F.col("position_precision"), F.col("geocoded"))
    g = m.groupBy("cluster_id").agg(
        *picks,
        F.array_sort(F.collect_list(values)).alias("_values"),
        F.collect_set(F.struct("lat", "lng")).alias("_points"),
        F.min(F.when(precision == text.SURVEYED, 0).when(precision == text.BY_ADDRESS, 1).otherwise(2)).alias("_precision"),
        F.array_sort(F.collect_list(F.struct("source_id", "rid", "source_record_id", "fetched_at", F.col("source_url").alias("url")))).alias("_sources"),
        F.count_distinct("source_id").cast("int").alias("source_count"),
        _collected().alias("_connectors"),
    )
    first = lambda f: F.to_json(F.struct(F.col(f"p_{f}.value").alias("v")), {"ignoreNullFields": "false"})

    def conflict(f: str) -> Column:
        seen = F.filter("_values", lambda v: v[f].isNotNull())
        kinds = F.array_distinct(F.transform(seen, lambda v: v[f]))
        others = F.filter(kinds, lambda k: k != first(f))
        return F.transform(others, lambda k: F.struct(F.get(F.filter(seen, lambda v: v[f] == k), F.lit(0))["source_id"].alias("source_id"), F.get_json_object(k, "$.v").alias("value")))

    fields = (*SCALARS, "position")
    provenance = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.struct(*[F.col(f"p_{f}")[x].alias(x) for x in ("source_id", "source_record_id", "fetched_at")]).alias("v")) for f in fields]), lambda e: e["v"]["source_id"].isNotNull()))
    conflicts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), conflict(f).alias("v")) for f in SCALARS]), lambda e: F.size(e["v"]) > 0))
    s = g.select(
        "cluster_id", *[F.col(f"p_{f}.value").alias(f) for f in SCALARS],
        F.round(F.col("p_position.value.lat"), 6).alias("lat"), F.round(F.col("p_position.value.lng"), 6).alias("lng"),
        F.element_at(F.array(*[F.lit(x) for x in text.PRECISION_ERROR_M]), F.col("_precision") + 1).alias("position_precision"),
        (F.col("_precision") > 0).alias("geocoded"), _by_standard(F.col("_connectors")).alias("connectors"), provenance.alias("provenance"), conflicts.alias("conflicts"),
        F.transform("_sources", lambda x: F.struct(*[x[k].alias(k) for k in ("source_id", "source_record_id", "fetched_at", "url")])).alias("sources"),
        "source_count", F.round(spread_m(F.col("_points"))).cast("int").alias("spatial_spread_m"),
    )
    return number_collisions(derive(s))


def derive(s: DataFrame) -> DataFrame:
    """Columns worked out from the merged ones: power, band, state, display name, id, confidence."""
    from_connectors = F.nullif(F.array_max(F.transform("connectors", lambda c: F.coalesce(c["power_kw"], F.lit(0.0)))), F.lit(0.0))
    s = s.withColumn("max_power_kw", F.coalesce(F.nullif("max_power_kw", F.lit(0.0)), from_connectors))
    s = s.withColumn("position_error_m", text.precision_error_m(F.col("position_precision"))).withColumn("speed_band", text.speed_band(F.col("max_power_kw")))
    s = s.withColumn("state", F.coalesce(F.nullif(F.col("address.state"), F.lit("")), geo.state_of(F.col("lat"), F.col("lng")))).withColumn("status", F.coalesce("status", F.lit("unknown")))
    suburb = F.coalesce(F.nullif(F.col("address.suburb"), F.lit("")), F.nullif(F.col("address.street"), F.lit("")))
    derived = F.concat_ws(" — ", F.when(F.col("operator") != "Non-networked", F.col("operator")), suburb)
    s = s.withColumn("name_is_derived", F.col("name").isNull())
    s = s.withColumn("display_name", F.coalesce("name", F.nullif(derived, F.lit("")), F.concat(F.lit("Charging site ("), F.coalesce("state", F.lit("AU")), F.lit(")"))))
    return s.withColumn("id", slug_id(F.col("lat"), F.col("lng"), F.col("operator"))).withColumn("confidence", confidence())


def confidence() -> Column:
    """Corroboration, completeness and agreement of a site's columns, in 0..1."""
    present = sum(F.col(f).isNotNull().cast("int") for f in ("name", "operator", "max_power_kw", "address"))
    raw = (
        0.2 * F.least(F.col("source_count"), F.lit(3)) + 0.25 * present / 4 + F.when(F.size("connectors") > 0, 0.15).otherwise(0.0)
        - 0.05 * F.least(F.size(F.map_keys("conflicts")), F.lit(4))
        - F.when(F.col("position_precision") == text.BY_ADDRESS, 0.1).when(F.col("position_precision") == text.BY_LOCALITY, 0.3).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw, 3)))


def resolve(records: DataFrame, cfg: MatchConfig = MatchConfig()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(sites, one row of counts)."""
    from geoloom.storage import materialize

    good = usable(conform(records), cfg)
    scored = materialize(score_pairs(candidate_pairs(good, cfg), cfg))
    sites = materialize(merge(good, clusters(good, links(scored, cfg)), cfg))
    counts = {}
    for part in (
        records.agg(F.count("*").alias("input_records"), F.count_if(~geo.is_valid(F.col("lat"), F.col("lng"), cfg.any_turn)).alias("rejected")),
        sites.agg(
            F.count("*").alias("sites"), F.count_if(F.col("source_count") > 1).alias("multi_source_sites"), F.count_if(F.size(F.map_keys("conflicts")) > 0).alias("sites_with_conflicts"),
            F.count_if(F.col("id") != slug_id(F.col("lat"), F.col("lng"), F.col("operator"))).alias("collisions_resolved"),
        ),
        scored.agg(F.count("*").alias("pairs_considered"), F.count_if(F.col("score") >= cfg.threshold).alias("links")),
    ):
        counts |= part.first().asDict()
    counts["merged"] = counts["input_records"] - counts["rejected"] - counts["sites"]
    names = ("input_records", "rejected", "sites", "merged", "multi_source_sites", "sites_with_conflicts", "pairs_considered", "links", "collisions_resolved")
    return sites, records.sparkSession.createDataFrame([tuple(int(counts[n]) for n in names)], ", ".join(f"{n} long" for n in names))

"""Search, resolution, drift and gates on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import components, drift, quality, resolve, rollups, search
from geoloom.operators.search import SiteQuery
from geoloom.schema import RECORD, conform

BASE = {"rid": 1, "source_id": "osm", "source_record_id": "a", "fetched_at": "2026-01-01 00:00:00", "lat": -33.8, "lng": 151.0, "name": "Seven Hills Plaza", "operator": "Chargefox", "status": "operational"}


def frame(spark, *rows):
    full = [{**BASE, "rid": k + 1, "source_record_id": str(k), **r} for k, r in enumerate(rows)]
    keys = list(dict.fromkeys(k for r in full for k in r))
    schema = ", ".join(f"{k} {'string' if k == 'fetched_at' else RECORD[k]}" for k in keys)
    return conform(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in full], schema))


def score(spark, a, b, **cfg):
    s = resolve.score_pairs(resolve.candidate_pairs(frame(spark, a, b)), resolve.MatchConfig(**cfg))
    row = s.first()
    return None if row is None else row.score


@pytest.mark.parametrize("b, low, high", [
    ({}, 1.0, 1.0), ({"operator": "Tesla"}, 0.0, 0.54), ({"lat": -33.8 + 0.0009}, 0.55, 1.0), ({"lat": -33.8 + 0.0009, "operator": None, "name": None}, 0.3, 0.54), ({"operator": None, "name": None}, 0.8, 0.8),
    ({"position_precision": "geocoded_locality"}, 0.0, 0.0), ({"name": "Harbour View", "operator": None}, 0.0, 0.54),
])
def test_scores(spark, b, low, high):
    s = score(spark, {}, b)
    assert low <= s <= high
    assert score(spark, b, {}) == pytest.approx(s)


def test_two_geocoded_need_names(spark):
    g = {"geocoded": True, "operator": None}
    assert score(spark, {**g, "name": "Mawson Club"}, {**g, "name": "Southlands Shopping"}) == 0
    assert score(spark, {**g, "name": "Mawson Club"}, {**g, "name": "Mawson Club"}) > 0.55


def test_merge(spark):
    address = ("1 A St, Town NSW 2000", "1 A St", "Town", "NSW", "2000")
    r = frame(
        spark, {"source_id": "osm", "access": "unknown", "max_power_kw": 50.0, "connectors": [("CCS2", 1, 50.0)]},
        {"source_id": "nsw", "operator": "Evie Networks", "name": None, "lat": -33.8002, "max_power_kw": 75.0, "address": address, "connectors": [("CCS2", 2, 75.0), ("CHAdeMO", 1, None)]},
    )
    m = spark.createDataFrame([(1, 1), (2, 1)], "rid long, cluster_id long")
    s = resolve.merge(r, m).first()
    assert (s.name, s.operator, s.lat, s.max_power_kw, s.source_count) == ("Seven Hills Plaza", "Evie Networks", -33.8, 75.0, 2)
    assert s.conflicts["operator"][0].value == "Chargefox" and s.provenance["operator"].source_id == "nsw"
    assert [(c.standard, c["count"], c.power_kw, c.sources) for c in s.connectors] == [("CCS2", 2, 75.0, ["osm", "nsw"]), ("CHAdeMO", 1, None, ["nsw"])]
    assert (s.state, s.speed_band, s.id, s.spatial_spread_m) == ("NSW", "fast", "au-s338000-1510000-evie-networks", 22)
    assert s.confidence == pytest.approx(0.2 * 2 + 0.25 + 0.15 - 0.05 * 2, abs=1e-9)


def test_resolve_is_order_free(spark):
    rng = random.Random(3)
    rows = [{"lat": -33.8 + rng.random() * 0.01, "lng": 151 + rng.random() * 0.01, "operator": rng.choice(["A", "B", None]), "source_id": rng.choice(["osm", "nsw"])} for _ in range(40)]
    one, stats = resolve.resolve(frame(spark, *rows))
    ids = sorted(r.id for r in one.select("id").collect())
    assert len(set(ids)) == len(ids) == stats.first().sites
    moved, _ = resolve.resolve(frame(spark, *rows).orderBy(F.rand(5)))
    assert sorted(r.id for r in moved.select("id").collect()) == ids
    strict = resolve.candidate_pairs(frame(spark, *rows), resolve.MatchConfig(strict_blocking=True)).select("a.rid", F.col("b.rid").alias("other")).collect()
    near = resolve.score_pairs(resolve.candidate_pairs(frame(spark, *rows))).where("distance_m <= 250").select("rid_a", "rid_b").collect()
    assert {tuple(x) for x in near} <= {tuple(x) for x in strict}


def test_empty(spark):
    sites, stats = resolve.resolve(frame(spark).limit(0) if False else conform(spark.createDataFrame([], "rid long")))
    assert sites.count() == 0 and stats.first().sites == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    extra = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3), (500, 500)]
    e = spark.createDataFrame(chain + extra, "a long, b long")
    parent = {x: x for x in itertools.chain(*[p for p in chain + extra if None not in p])}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain + extra:
        if a is not None and b is not None and find(a) != find(b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(e.limit(0)).count() == 0


SITES = "id string, name string, display_name string, operator string, lat double, lng double, state string, max_power_kw double, speed_band string, status string, source_count int, confidence double, address struct<suburb:string,street:string,postcode:string>"


@pytest.fixture
def sites(spark):
    return spark.createDataFrame([
        ("a", "Central Plaza", "Central Plaza", "Tesla", -33.80, 151.00, "NSW", 250.0, "ultra", "operational", 2, 0.9, ("Hills", "1 A St", "2147")),
        ("b", None, "Evie at Coast", "Evie Networks", -33.81, 151.01, "NSW", None, "unknown", "unknown", 1, 0.4, ("Gold Coast", None, "4217")),
        ("c", "Old", "Old", None, -37.80, 145.00, "VIC", 22.0, "slow", "planned", 1, 0.5, None),
    ], SITES)


@pytest.mark.parametrize("raw, ids", [
    ({}, "ab"), ({"include_planned": True}, "acb"), ({"max_power_kw": 50}, "b"), ({"min_power_kw": 50}, "a"), ({"text": "gold coast"}, "b"), ({"text": "central coast"}, ""), ({"operators": ["Tesla"]}, "a"), ({"states": ["nsw"], "sort": "confidence"}, "ab"),
    ({"lat": -33.81, "lng": 151.01}, "ba"), ({"lat": -33.81, "lng": 151.01, "radius_km": 0.5}, "b"), ({"limit": 1, "offset": 1}, "b"), ({"min_sources": 2}, "a"),
])
def test_search(sites, raw, ids):
    assert "".join(r.id for r in search.search(sites, SiteQuery.from_raw(**raw)).page.collect()) == ids


def test_query_errors(sites):
    for bad in ({"radius_km": 5}, {"limit": -1}, {"limit": float("nan")}, {"sort": "size"}):
        with pytest.raises(ValueError):
            SiteQuery.from_raw(**bad)
    with pytest.raises(ValueError):
        search.nearest(sites, None, 1.0)
    q = search.from_params({"states": "nsw,vic", "min_kw": "50", "bbox": "150,-34,152,-33", "includePlanned": "", "q": "x"})
    assert q.states == ("NSW", "VIC") and q.box == (-34.0, -33.0, 150.0, 152.0) and q.min_power_kw == 50 and "planned" in q.statuses
    assert SiteQuery.from_raw(limit=None).limit is None and SiteQuery.from_raw(limit=99999).limit == 10000


def test_plans(spark, sf):
    """Filters and columns reach the scan, blocking joins by equality, top-k stays bounded."""
    from geoloom.plans import records
    from geoloom.plans.queries import QUERIES

    def plan(d):
        return d._jdf.queryExecution().toString()

    t = records.table(spark, sf, "lineitem")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan(t.where("l_quantity > 10").select("l_orderkey"))
    assert "NestedLoop" not in plan(QUERIES["candidate_pairs"](spark, sf)) and "Cartesian" not in plan(QUERIES["pair_scores"](spark, sf))
    assert "TakeOrderedAndProject" in plan(QUERIES["nearest_k"](spark, sf))


def run(spark, *rows):
    return spark.createDataFrame(rows, "source_id string, record_count long, issue_rate double, structural_issue_rate double, error string, skipped boolean, served_from string, stale_fallback boolean")


@pytest.mark.parametrize("prev, cur, level", [
    ((100, 0.3, None, None, False, "u", False), (100, 0.3, None, None, False, "u", False), "ok"), ((100, 0.0, None, None, False, "u", False), (85, 0.0, None, None, False, "u", False), "warn"), ((100, 0.0, None, None, False, "u", False), (60, 0.0, None, None, False, "u", False), "fail"),
    (None, (5, 0.0, None, None, False, "u", False), "ok"), ((100, 0.0, None, None, False, "u", False), (0, 0.0, None, None, False, "u", False), "fail"), ((100, 0.0, None, None, False, "u", False), (0, 0.0, None, "boom", False, "u", False), "fail"), ((100, 0.0, None, None, False, "u", False), (0, 0.0, None, None, True, "u", False), "ok"),
    ((100, 0.9, 0.1, None, False, "u", False), (100, 0.9, 0.22, None, False, "u", False), "warn"), ((100, 0.9, 0.1, None, False, "u", False), (100, 0.9, 0.4, None, False, "u", False), "fail"), ((100, 0.0, 0.8, None, False, "u", False), (100, 0.0, 0.8, None, False, "u", False), "fail"),
    ((100, 0.0, None, None, False, "u", False), (100, 0.0, None, None, False, "v", False), "warn"), ((100, 0.0, None, None, False, "u", False), (100, 0.0, None, None, False, "u", True), "warn"),
])
def test_drift(spark, prev, cur, level):
    before = run(spark, ("s", *prev)) if prev else run(spark, ("other", 1, 0.0, None, None, False, "u", False))
    assert drift.worst(drift.detect(before, run(spark, ("s", *cur)))) == level


def test_gates(spark):
    d = spark.createDataFrame([("s", "1", -33.0, 151.0), ("s", "2", 51.0, 0.1), ("s", "3", None, 1.0), ("s", "4", 0.0, 0.0)], "source_id string, source_record_id string, lat double, lng double")
    good, issues = quality.split_rejected(d)
    assert good.count() == 1 and issues.count() == 3 and {r.kind for r in issues.collect()} == {"rejected"}
    assert quality.totals_match(d, {"n": F.lit(1)}, {"n": 4}) is None and "does not match" in quality.totals_match(d, {"n": F.lit(1)}, {"n": 5})
    assert quality.expect_columns(d, "lat", "x") == "missing columns: x" and quality.expect_rows(d.limit(0)) is not None
    stats = rollups.source_stats(good.withColumn("status", F.lit("planned")), issues).first()
    assert (stats.record_count, stats.planned_count, stats.structural_count, stats.issue_rate) == (1, 1, 3, 3.0)


def test_clear(spark, monkeypatch):
    from geoloom import storage

    monkeypatch.setattr(storage, "_made", [])
    d = storage.materialize(spark.range(3))
    assert d.count() == 3 and storage.clear(spark) == 1 and storage.clear(spark) == 0

"""Queries over tables whose keys run on, as those of large tables do, and ties."""

import duckdb
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.plans.queries import ORACLES, QUERIES
from geoloom.sources.adapters import Nsw


@pytest.fixture(scope="module")
def far(tmp_path_factory, sf):
    """Orders with their own keys, beyond 180 degrees east, and a whole turn on."""
    d, con = tmp_path_factory.mktemp("far"), duckdb.connect()
    con.execute(f"COPY (SELECT t.* REPLACE (o_orderkey + shift AS o_orderkey) FROM '{sf}/orders.parquet' t, (VALUES (0), (1200000), (8640000)) v(shift)) TO '{d}/orders.parquet' (FORMAT parquet)")
    for t in ("customer", "part"):
        con.execute(f"COPY (SELECT * FROM '{sf}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
    for t in ("orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["quality_gates", "resolution_counts", "rough_metres", "sort_name", "usable_positions", "resolve_stats"])
def test_far_keys(name, spark, far, same):
    same(QUERIES[name](spark, far[0]), far[1].execute(ORACLES[name]))


def test_across_the_date_line(spark):
    d = spark.createDataFrame([(-17.0, 179.99, -17.0, -179.99)], "a double, b double, c double, d double")
    exact, rough = d.select(geo.haversine_m(*map(F.col, "abcd")), geo.rough_m(*map(F.col, "abcd"))).first()
    assert rough == pytest.approx(exact, rel=2e-3)


def test_box_all_the_way_round(spark):
    d = spark.createDataFrame([(-37.8, 145.0), (-37.8, 505.0), (-37.8, None), (-37.8, float("nan"))], "lat double, lng double")
    inside = lambda *box: [r[0] for r in d.select(geo.in_box(F.col("lat"), F.col("lng"), box)).collect()]
    assert inside(-90, 0, -180, 180) == [True, True, False, False]
    assert inside(-90, 0, 140, 150)[:2] == [True, False]


def test_newest_resource_first_of_equals(spark):
    shape = "number int, result struct<resources:array<struct<format:string,name:string,url:string,last_modified:string,created:string>>>"
    csv = lambda url, at, made: ("CSV", "data", url, at, made)
    rows = [(2, ([csv("late", "2026-02-01", None)],)), (1, ([csv("old", "2026-01-01", "2026-03-01"), csv("first", "", "2026-02-01"), csv("second", "2026-02-01", None)],)), (3, ([csv("none", None, None)],))]
    p = spark.createDataFrame(rows, shape)
    assert Nsw.newest_resource(p, F.col("number")).first().url == "first"
    assert Nsw.newest_resource(p.where("number = 1")).first().url == "first"


def test_report_without_resolving(spark, tmp_path, monkeypatch):
    """The counts of a run need no pair of records: 300 of one place would give 44,850."""
    from geoloom import ingest
    from geoloom.sources.adapters import Context

    rows = "\n".join(f"Place {k},-27.5,153.0,1 A St,x,1,Host,Active,y" for k in range(300))
    (tmp_path / "q.csv").write_text(f"Location Name,Latitude,Longitude,Address,Description,Charging plugs available,Host,Status,Nearest QESH charging station\n{rows}\n")
    real, calls = ingest.resolve, []
    monkeypatch.setattr(ingest, "resolve", lambda *a: calls.append(1) or real(*a))
    run = ingest.ingest(spark, {"qld": f"file://{tmp_path}/q.csv"}, Context(fetched_at="2026-09-05 00:00:00", as_of="2026-09-05"))
    assert run.source_stats.first().record_count == 300 and not calls
    assert run.sites.count() == 1 and run.resolution.first().pairs_considered == 44_850 and len(calls) == 1

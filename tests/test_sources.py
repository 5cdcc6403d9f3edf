"""Adapters, exports and the whole run on small raw files."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom import export, ingest, sources, streaming
from geoloom.schema import RECORD, conform
from geoloom.sources import tabular
from geoloom.sources.adapters import Context

CTX = dict(fetched_at="2026-09-05 00:00:00", as_of="2026-09-05")


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return f"file://{p}"

    return write


def test_csv(spark, put):
    d = tabular.read_csv(spark, put("a.csv", '﻿a,a,b \r\n1,"x ""y""\nz",3\r\n2\r\n\r\n4,5,6,7\r\n'))
    assert d.columns == ["a", "a_2", "b"]
    assert [tuple(r) for r in d.collect()] == [("1", 'x "y"\nz', "3"), ("2", "", ""), ("4", "5", "6")]
    lines = [r.value for r in tabular.csv_lines(d).collect()]
    assert lines[1:] == ["2,,", "4,5,6"] and lines[0] == '1,"x ""y""\nz",3'


NSW = """OBJECTID,Station_name,Station_address,PCODE,LGANAME,Latitude,Longitude,Operator,Charger_Type,Charger_rating,Number_of_plugs,Source
1,Plaza,"38 Abbott Rd, Seven Hills",2147,Blacktown,-33.77,150.93,BP Australia,DC,2x350kW & 2x175kW,4,Existing
,,"Main St, Town",,X,-33.70,150.90,Tesla Motors,AC,AC,2,Round
3,Later,", Muswellbrook, 2333",,X,-32.26,150.88,PLUS ES Manag,Upcoming,2x350kW & 2x175kW,,Round
4,Bad,,,,0,0,Evie,AC,22 kW,1,Round
"""


def test_nsw(spark, put):
    r, i = sources.select(["nsw"])[0].read(spark, put("n.csv", NSW), Context(**CTX))
    rows = {x.source_record_id: x for x in r.collect()}
    a = rows["objectid:1"]
    assert (a.operator, a.max_power_kw, a.plug_count, a.address.postcode, a.address.state, a.status) == ("BP Pulse", 350.0, 4, "2147", "NSW", "operational")
    assert [(c.standard, c["count"], c.power_kw) for c in a.connectors] == [("DCUnspecified", 2, 350.0), ("DCUnspecified", 2, 175.0)]
    b = next(v for k, v in rows.items() if k.startswith("row:"))
    assert [(c.standard, c["count"], c.power_kw) for c in b.connectors] == [("ACUnspecified", 2, None)]
    c = rows["objectid:3"]
    assert c.status == "planned" and {x.standard for x in c.connectors} == {"DCUnspecified"} and c.address.suburb == "Muswellbrook"
    assert sorted(x.kind for x in i.collect()) == ["data_gap", "rejected", "status_flag"]


def test_nsw_resource(spark):
    src = sources.select(["nsw"])[0]
    p = spark.createDataFrame([(([("CSV", "old, not updated", "u1", "2026-05-01", "1"), ("csv", "data", "u2", "2026-02-01", "1"), ("csv", "data", "u3", None, "2026-03-01"), ("PDF", "x", "u4", "2027", "1")],),)], "result struct<resources:array<struct<format:string,name:string,url:string,last_modified:string,created:string>>>")
    assert src.newest_resource(p).first().url == "u3"


def test_qld(spark, put):
    text = 'Location Name,Latitude,Longitude,Address,Description,Charging plugs available,Host,Status,Nearest QESH charging station\n"Town\nHall",-27.5,153.0,"1 A St, Brisbane",x,,City Council,Active,y\nNowhere,,,z,,,,,\n'
    r, i = sources.select(["qld"])[0].read(spark, put("q.csv", text), Context(**CTX))
    a = r.first()
    assert (a.source_record_id, a.name, a.operator, a.status, a.address.state, r.count()) == ("qesh:town-hall", "Town Hall", "City Council", "operational", "QLD", 1)
    assert sorted(x.kind for x in i.collect()) == ["data_gap", "rejected"]


def test_osm(spark, put):
    raw = {"osm3s": {"timestamp_osm_base": "2026-09-04T00:00:00Z"}, "elements": [
        {"type": "node", "id": 1, "lat": -33.8, "lon": 151.0, "tags": {"operator": "Evie", "socket:type2_combo": "2", "socket:type2_combo:output": "350 kW", "socket:chademo": "yes", "access": "customers", "fee": "yes", "capacity": "4", "addr:street": "A St", "addr:housenumber": "1", "addr:city": "Town"}},
        {"type": "way", "id": 2, "center": {"lat": -33.9, "lon": 151.1}, "tags": {"name": "Hub", "proposed": "yes"}}, {"type": "count", "id": 0, "tags": {"total": "2"}}, {"type": "node", "id": 3, "lat": 51.0, "lon": 0.0, "tags": {}},
    ]}
    s, path = sources.select(["osm"])[0], put("o.json", raw)
    r, i = s.read(spark, path, Context(**CTX))
    rows = {x.source_record_id: x for x in r.collect()}
    a = rows["node/1"]
    assert (a.name, a.name_from_operator, a.operator, a.max_power_kw, a.plug_count, a.access, a.fee, a.address.suburb) == ("Evie", True, "Evie Networks", 350.0, 4, "restricted", True, "Town")
    assert sorted((c.standard, c["count"], c.power_kw) for c in a.connectors) == [("CCS2", 2, 350.0), ("CHAdeMO", None, None)]
    assert rows["way/2"].status == "planned" and rows["way/2"].lat == -33.9 and i.count() == 1
    assert s.validate(spark, path, Context(**CTX)) is None
    assert "7 days" in s.validate(spark, path, Context(fetched_at=CTX["fetched_at"], as_of="2026-09-20"))


def test_vic(spark, put):
    def feature(**p):
        return {"id": p.pop("id", None), "geometry": {"coordinates": [145.0, -37.8]}, "properties": p}

    raw = {"type": "FeatureCollection", "features": [
        feature(id="1", location="Tatura", company="Chargefox", address="1 A St, Tatura", plug_type="1 x CHAdeMO and 1 x CCS2/SAE", chargers="1 x 50kW Charger", number_of_chargers=1, estimated_project_completion="31/07/2023"),
        feature(id="2", location="Later", plug_type="2 x Type 2", chargers="2 x 22kW", estimated_project_completion="December 2026"), feature(id="3", location="Odd", plug_type="??", estimated_project_completion="soon"),
    ]}
    s = sources.select(["vic"])[0]
    r, i = s.read(spark, put("v.json", raw), Context(**CTX))
    rows = {x.source_record_id: x for x in r.collect()}
    assert [(c.standard, c["count"], c.power_kw) for c in rows["dcav:1"].connectors] == [("CHAdeMO", 1, 50.0), ("CCS2", 1, 50.0)]
    assert [rows[f"dcav:{k}"].status for k in "123"] == ["operational", "planned", "unknown"]
    assert sorted(x.kind for x in i.collect()) == ["parse_failure", "parse_failure", "status_flag"]
    assert s.validate(spark, put("x.json", '<?xml version="1.0"?><ExceptionReport/>'), Context(**CTX)) is not None


def test_ocm(spark, put):
    raw = [
        {"ID": 1, "AddressInfo": {"Latitude": -33.8, "Longitude": 151.0, "Title": "Hub", "Town": "Town", "Postcode": "2000"}, "Connections": [{"ConnectionType": {"Title": "CCS (Type 2)"}, "Quantity": 2, "PowerKW": 50.0}], "StatusType": {"IsOperational": True}, "UsageType": {"IsPayAtLocation": False}, "DataProvider": {"Title": "P", "IsOpenDataLicensed": True}},
        {"ID": 2, "AddressInfo": {"Latitude": -33.8, "Longitude": 151.0}, "DataProvider": {"Title": "Closed", "IsOpenDataLicensed": False}},
    ]
    r, i = sources.select(["ocm"])[0].read(spark, put("c.json", raw), Context(**CTX))
    a = r.first()
    assert r.count() == 1 and (a.status, a.fee, a.max_power_kw, a.connectors[0].standard) == ("operational", False, 50.0, "CCS2")
    assert [x.kind for x in i.collect()] == ["policy"]


def _act():
    from geoloom.sources.adapters import ACT_DISTRICTS

    out = ["<p>As of December 2025, 7 public EV chargers with 14 charging bays have received funding</p>"]
    for k, d in enumerate(ACT_DISTRICTS):
        out.append(f"<button class='x'><span>{d}</span></button><table><tr><th>Number of chargers</th><th>Number of charging bays</th><th>Charger type</th><th>Plug type</th><th>Location</th></tr><tr><td>1</td><td>2</td><td>22kW AC</td><td>Bring your own Type 1 or Type 2</td><td>Venue {chr(65 + k)} {k + 1} Main Way, {d}</td></tr></table>")
    return "".join(out)


def _cache(spark, *rows):
    return spark.createDataFrame(rows, "key string, result struct<lat:double,lng:double,display_name:string,type:string>")


def test_act(spark, put):
    s, path = sources.select(["act"])[0], put("act.html", _act())
    cache = _cache(spark, ("1 main way belconnen", (-35.24, 149.07, "m", "t")), ("2 main way gungahlin", None))
    ctx = Context(**CTX, geocodes=cache)
    assert s.validate(spark, path, ctx) is None
    assert "does not match" in s.validate(spark, put("b.html", _act().replace("<td>2</td>", "<td>3</td>", 1)), ctx)
    r, i = s.read(spark, path, ctx)
    a = r.first()
    assert r.count() == 1 and (a.name, a.address.state, a.plug_count, a.max_power_kw, a.extra["district"], a.geocoded) == ("Venue A", "ACT", 2, 22.0, "Belconnen", True)
    assert sorted(c.standard for c in a.connectors) == ["Type1", "Type2"] and {c.power_kw for c in a.connectors} == {22.0}
    why = [x.issue for x in i.where("kind = 'rejected'").collect()]
    assert sum("not in the geocode cache" in w for w in why) == 5 and sum("found no coordinate" in w for w in why) == 1


def test_tas(spark, put):
    page = "".join(f"<h3>{k} charging grants</h3><table><tr><th>Organisation</th><th>Location</th><th>Region</th><th>Amount</th></tr><tr><td>Council (two chargers)</td><td>St Helens (Upgrade)</td><td>North</td><td>$50,000</td></tr><tr><td>Shop</td><td>Miena</td><td>South</td><td>$1,000</td></tr><tr><td>Total</td><td></td><td></td><td>$51,000</td></tr></table>" for k in ("Fast", "Destination", "Workplace"))
    s, path = sources.select(["tas"])[0], put("tas.html", page)
    ctx = Context(**CTX, geocodes=_cache(spark, ("st helens", (-41.3, 148.2, None, None)), ("miena", (-33.0, 151.0, None, None))))
    r, i = s.read(spark, path, ctx)
    rows = r.collect()
    assert len(rows) == 3 and {x.position_precision for x in rows} == {"geocoded_locality"} and {x.plug_count for x in rows} == {2}
    assert sorted(x.connectors[0].standard for x in rows) == ["ACUnspecified", "ACUnspecified", "DCUnspecified"] and rows[0].name == "Council — St Helens"
    assert i.where("issue like '%outside the state%'").count() == 3
    assert "fewer than 40" in s.validate(spark, path, ctx) and "sum to" in s.validate(spark, put("t.html", page.replace("$1,000", "$2,000", 1)), ctx)


def test_registry(spark):
    assert [s.id for s in sources.select()] == ["osm", "nsw", "vic", "qld", "act", "tas"] and [s.id for s in sources.select(["ocm"])] == ["ocm"]
    with pytest.raises(ValueError):
        sources.select(["nope"])
    assert sources.catalogue(spark).count() == 7 and {r.source_id for r in sources.attribution(spark, ["osm", "act"]).collect()} == {"osm", "act", "geocoding"}


def test_run_and_exports(spark, put, tmp_path):
    run = ingest.ingest(spark, {"nsw": put("n.csv", NSW), "qld": put("bad.csv", "<html>no</html>")}, Context(**CTX))
    stats = {r.source_id: r for r in run.source_stats.collect()}
    assert "Latitude" in stats["qld"].error and stats["nsw"].record_count == 3 and run.sites.count() == 3
    ingest.save(run, f"file://{tmp_path}/d")
    sites = ingest.load(spark, f"file://{tmp_path}/d")
    with pytest.raises(FileNotFoundError):
        ingest.load(spark, f"file://{tmp_path}/none")
    assert ingest.load(spark, f"file://{tmp_path}/none", "resolution") is None
    meta = {"generated_at": "2026-09-05", "licence": "ODbL 1.0", "attribution": [{"text": "t", "licence": "l", "licence_url": "u"}]}
    export.write(sites, "bundle", f"file://{tmp_path}/x", meta)
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/x/csv/1-rows").collect()]
    assert len(lines) == 3 and any("DCUnspecifiedx2@350kW" in x for x in lines)
    one = {}
    for f in ("geojson", "json", "csv"):
        export.join_parts(spark, [f"file://{tmp_path}/x/{f}"], f"file://{tmp_path}/one.{f}")
        one[f] = (tmp_path / f"one.{f}").read_text()
    features = json.loads(one["geojson"])
    assert features["type"] == "FeatureCollection" and {f["geometry"]["type"] for f in features["features"]} == {"Point"} and len(features["features"]) == 3
    assert [f["properties"]["id"] for f in features["features"]] == sorted(f["properties"]["id"] for f in features["features"]) == [x["id"] for x in json.loads(one["json"])["sites"]]
    assert one["csv"].splitlines()[0].startswith("# geoloom") and one["csv"].splitlines()[-3].count(",") >= 22
    export.write(sites.limit(0), "geojson", f"file://{tmp_path}/none", meta)
    export.join_parts(spark, [f"file://{tmp_path}/none/geojson"], f"file://{tmp_path}/none.geojson")
    assert json.loads((tmp_path / "none.geojson").read_text())["features"] == []
    assert spark.read.parquet(f"file://{tmp_path}/d/counts").first().source_records == 3
    assert export.slim(sites).count() == 3
    with pytest.raises(ValueError):
        export.write(sites, "pdf", f"file://{tmp_path}/y", meta)


def test_stream(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("rid"), F.lit("osm").alias("source_id"), (F.col("id") % 3).cast("string").alias("source_record_id"), F.lit("2026-01-01").cast("timestamp").alias("fetched_at"), (F.lit(-33.8) + F.col("id") * 0.1).alias("lat"), F.lit(151.0).alias("lng"))
    conform(rows, RECORD).write.parquet(f"file://{tmp_path}/in")
    q = streaming.start(streaming.read_records(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/store", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/store/records").count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/store/touched").count() == 27


def test_refresh_equals_resolving_all(spark, tmp_path):
    """Batches that join, extend and leave alone old clusters give the sites of one run over all records."""
    import random

    from geoloom.operators.resolve import resolve

    rng, rows = random.Random(6), []
    for k in range(120):
        place = rng.randrange(25)
        rows.append((k, rng.choice(["osm", "nsw", "vic"]), str(k), -33.8 + (place % 5) * 0.004 + rng.random() * 0.0012, 151.0 + (place // 5) * 0.004 + rng.random() * 0.0012, rng.choice(["Evie Networks", "Tesla", None]), f"2026-01-0{1 + k % 5}"))
    d = conform(spark.createDataFrame(rows, "rid long, source_id string, source_record_id string, lat double, lng double, operator string, fetched_at string"), RECORD)
    store = f"file://{tmp_path}/store"
    moved = d.where("rid IN (3, 40)").withColumns({"lat": F.lit(-33.7995), "lng": F.lit(151.0005)})
    for version, part in enumerate((d.where("rid < 70"), d.where("rid BETWEEN 70 AND 71"), d.where("rid > 71"), moved)):
        part.write.parquet(f"{store}/records/batch={version}")
        streaming.touched_cells(part).write.parquet(f"{store}/touched/batch={version}")
        got = streaming.refresh(spark, store, version)
        want, _ = resolve(d.where(f"rid < {(70, 72, 1000)[version]}") if version < 3 else d.where("rid NOT IN (3, 40)").unionByName(moved))
        key = lambda x: sorted((r.cluster_id, r.id, r.lat, r.lng, r.operator, r.source_count, r.confidence) for r in x.collect())
        assert key(got) == key(want) and want.count() > 10

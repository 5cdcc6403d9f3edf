"""Queries over raw files in each source's shape, written from the driver's tables and read by the adapters.

Files hold at most PER_FILE rows each, so no task gathers more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom import sources
from geoloom.operators import lookup, quality, rollups
from geoloom.plans.records import table
from geoloom.plans.registry import query
from geoloom.sources import tabular
from geoloom.sources.adapters import ACT_DISTRICTS, Context, Nsw
from geoloom.storage import shared_dir

PER_FILE = 1000
CTX = Context(fetched_at="2026-09-05 00:00:00", as_of="2026-09-05")


def _files(lines: DataFrame, key: str, head: str, between: str, tail: str = "") -> str:
    """The folder of text files with the ``value`` of up to PER_FILE rows each, in the order of ``key``."""
    body = F.array_join(F.array_sort(F.collect_list(F.struct(key, "value"))).getField("value"), between)
    docs = lines.groupBy(F.floor(F.col(key) / PER_FILE).alias("file")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))
    return _written(docs.select("value"))


def _written(docs: DataFrame) -> str:
    path = shared_dir(docs.sparkSession)
    docs.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _page(spark: SparkSession, text: str) -> str:
    return _written(spark.createDataFrame([(text,)], "value string"))


def _id(source: str):
    return sources.select([source])[0]


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(x["count"], F.lit(0)))


# --- CSV -----------------------------------------------------------------------
@query("csv_round_trip", """SELECT CAST(p_partkey AS VARCHAR) AS a, CASE p_partkey % 4 WHEN 0 THEN p_name || ', "' || p_brand || '"' WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN ' ' || p_name || ' ' ELSE '' END AS a_2, CAST(p_size AS VARCHAR) AS "size"
FROM part""")
def csv_round_trip(spark, d):
    k = F.col("p_partkey")
    told = F.when(k % 4 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(k % 4 == 1, F.concat("p_name", F.lit("\n"), "p_brand")).when(k % 4 == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise("")
    rows = table(spark, d, "part").select("p_partkey", k.alias("first"), told.alias("second"), F.col("p_size").alias("third"))
    lines = rows.select("p_partkey", F.concat_ws(",", *[tabular.csv_cell(F.col(c)) for c in ("first", "second", "third")]).alias("value"))
    return tabular.read_csv(spark, _files(lines, "p_partkey", "﻿a,a, size \r\n", "\r\n", "\r\n\r\n"))


# --- NSW -----------------------------------------------------------------------
def _nsw_file(spark: SparkSession, d: str) -> str:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    of = lambda n, *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (k % n + 1).cast("int"))
    out = k % 13 == 5
    cells = (
        k.cast("string"), F.concat(F.lit("Site  "), "c_name"), F.concat(k.cast("string"), F.lit(" Main Rd, Seven Hills")), F.when(k % 5 == 2, "x12").otherwise((2000 + k % 900).cast("string")), F.col("c_mktsegment"),
        F.when(out, "0").otherwise(F.format_string("%.2f", -33.5 - (k % 100) / 100)), F.when(out, "0").otherwise(F.format_string("%.2f", 150.0 + (k % 50) / 50)), of(3, "Tesla Motors", "BP Australia", F.col("c_name")), of(4, "DC", "AC", "Upcoming", "DC"),
        of(5, "2x350kW & 2x175kW", "22 kW", "", "AC", "7kW"), F.when(k % 9 != 0, (k % 9).cast("string")).otherwise(""), F.lit("Round 1"),
    )
    lines = c.select("c_custkey", F.concat_ws(",", *[tabular.csv_cell(x) for x in cells]).alias("value"))
    head = "OBJECTID,Station_name,Station_address,PCODE,LGANAME,Latitude,Longitude,Operator,Charger_Type,Charger_rating,Number_of_plugs,Source\n"
    return _files(lines, "c_custkey", head, "\n")


def _nsw(spark, d):
    return _id("nsw").read(spark, _nsw_file(spark, d), CTX)


NSW_SQL = """n AS (SELECT c_custkey AS k, c_name, c_mktsegment, (['dc', 'ac', 'upcoming', 'dc'])[c_custkey % 4 + 1] AS kind, c_custkey % 5 AS rating, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 9 END AS plugs FROM customer)"""


@query("source_nsw", f"""WITH {NSW_SQL}
SELECT 'objectid:' || k AS id, round(-33.5 - (k % 100) / 100.0, 2) AS lat, round(150.0 + (k % 50) / 50.0, 2) AS lng, 'Site ' || c_name AS name, (['Tesla', 'BP Pulse', c_name])[k % 3 + 1] AS operator, 'Seven Hills' AS suburb, 'NSW' AS state,
  CASE WHEN k % 5 = 2 THEN CASE WHEN k BETWEEN 1000 AND 9999 THEN CAST(k AS VARCHAR) END WHEN k BETWEEN 1000 AND 9999 THEN CAST(k AS VARCHAR) ELSE CAST(2000 + k % 900 AS VARCHAR) END AS postcode, CAST(plugs AS INT) AS plug_count,
  CASE rating WHEN 0 THEN 350.0 WHEN 1 THEN 22.0 WHEN 4 THEN 7.0 END AS max_power_kw, CASE kind WHEN 'upcoming' THEN 'planned' ELSE 'operational' END AS status,
  CAST(CASE WHEN rating = 0 THEN 2 WHEN kind = 'upcoming' THEN 0 ELSE 1 END AS INT) AS standards, CAST(CASE WHEN rating = 0 THEN 4 WHEN kind = 'upcoming' THEN 0 WHEN rating IN (1, 4) THEN 1 ELSE coalesce(plugs, 0) END AS INT) AS connector_plugs,
  CASE WHEN rating = 0 AND kind = 'upcoming' THEN 'DCUnspecified' WHEN kind = 'dc' THEN 'DCUnspecified' WHEN kind = 'ac' THEN 'ACUnspecified' END AS standard, c_mktsegment AS lga
FROM n WHERE k % 13 <> 5""")
def source_nsw(spark, d):
    return _nsw(spark, d)[0].select(
        F.col("source_record_id").alias("id"), "lat", "lng", "name", "operator", "address.suburb", "address.state", "address.postcode", "plug_count", "max_power_kw", "status",
        F.size("connectors").alias("standards"), _sum(F.col("connectors")).alias("connector_plugs"), F.get("connectors", F.lit(0))["standard"].alias("standard"), F.element_at("extra", "lga").alias("lga"),
    )


@query("source_nsw_issues", f"""WITH {NSW_SQL}, i AS (SELECT k, 'rejected' AS kind FROM n WHERE k % 13 = 5 UNION ALL SELECT k, 'data_gap' FROM n WHERE k % 13 <> 5 AND rating = 3 UNION ALL SELECT k, 'status_flag' FROM n WHERE k % 13 <> 5 AND kind = 'upcoming')
SELECT 'objectid:' || k AS id, kind FROM i""")
def source_nsw_issues(spark, d):
    return _nsw(spark, d)[1].select(F.col("source_record_id").alias("id"), "kind")


@query("newest_resource", "SELECT 'page-' || arg_max(page_id, (page_id * 37) % 1009) AS url FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0")
def newest_resource(spark, d):
    """The resource of the latest change among the CSV ones that are kept; the pages stand for the resources of one entry."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    at = F.lpad(((k * 37) % 1009).cast("string"), 6, "0")
    r = F.struct(F.when(k % 3 == 0, "PDF").otherwise("csv").alias("format"), F.when(k % 5 == 0, "Old, not updated").otherwise("data").alias("name"), F.concat(F.lit("page-"), k.cast("string")).alias("url"), F.when(k % 2 == 0, at).alias("last_modified"), F.when(k % 2 == 1, at).otherwise("").alias("created"))
    return Nsw.newest_resource(p.select("page_id", F.struct(F.array(r).alias("resources")).alias("result")), k)


# --- QLD -----------------------------------------------------------------------
def _qld_file(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    cells = (
        F.concat(F.lit("Town\nHall "), k.cast("string")), F.when(k % 7 != 3, F.format_string("%.2f", -27.0 - (k % 90) / 100)).otherwise(""), F.when(k % 7 != 3, F.lit("153.00")).otherwise(""), F.concat(k.cast("string"), F.lit(" A St, Brisbane")), F.lit("x, y"),
        F.when(k % 4 != 0, (k % 4).cast("string")).otherwise(" "), F.when(k % 2 == 0, "City  Council").otherwise("chargefox"), F.when(k % 3 == 0, "Active").when(k % 3 == 1, "Coming soon").otherwise(""), F.lit("next"),
    )
    lines = s.select("s_suppkey", F.concat_ws(",", *[tabular.csv_cell(x) for x in cells]).alias("value"))
    return _files(lines, "s_suppkey", "Location Name,Latitude,Longitude,Address,Description,Charging plugs available,Host,Status,Nearest QESH charging station\n", "\n")


def _qld(spark, d):
    return _id("qld").read(spark, _qld_file(spark, d), CTX)


@query("source_qld", """SELECT 'qesh:town-hall-' || s_suppkey AS id, 'Town Hall ' || s_suppkey AS name, round(-27.0 - (s_suppkey % 90) / 100.0, 2) AS lat, CASE s_suppkey % 2 WHEN 0 THEN 'City Council' ELSE 'Chargefox' END AS operator, 'QLD' AS state, 'Brisbane' AS suburb,
  CAST(nullif(s_suppkey % 4, 0) AS INT) AS plug_count, CASE s_suppkey % 3 WHEN 0 THEN 'operational' WHEN 1 THEN 'planned' ELSE 'unknown' END AS status FROM supplier WHERE s_suppkey % 7 <> 3""")
def source_qld(spark, d):
    return _qld(spark, d)[0].select(F.col("source_record_id").alias("id"), "name", "lat", "operator", "address.state", "address.suburb", "plug_count", "status")


@query("source_qld_issues", "SELECT 'qesh:town-hall-' || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 3 THEN 'rejected' ELSE 'data_gap' END AS kind FROM supplier WHERE s_suppkey % 7 = 3 OR s_suppkey % 4 = 0")
def source_qld_issues(spark, d):
    return _qld(spark, d)[1].select(F.col("source_record_id").alias("id"), "kind")


# --- OpenStreetMap ---------------------------------------------------------------
def _json(d: DataFrame, key: str, **fields: Column) -> DataFrame:
    return d.select(key, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


def _tags(**tags: Column) -> Column:
    """A map of the tags that are not null; two underscores in a name stand for a colon."""
    return F.map_filter(F.create_map(*[x for k, v in tags.items() for x in (F.lit(k.replace("__", ":")), v)]), lambda k, v: v.isNotNull())


def _osm(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    when = lambda n, r, v: F.when(k % n == r, v)
    tags = _tags(
        name=F.when(k % 3 == 0, F.concat(F.lit("Hub "), k.cast("string"))), operator=F.when(k % 4 != 1, F.lit("Evie")), brand=when(4, 1, F.lit("chargefox")), socket__type2_combo=when(2, 0, F.lit("2")), socket__type2_combo__output=when(2, 0, F.lit("350 kW")),
        socket__chademo=when(3, 0, F.lit("yes")), access=when(5, 0, F.lit("customers")), fee=F.when(k % 2 == 0, "yes").when(k % 7 == 0, "no"), capacity=when(6, 1, F.lit("4")), addr__housenumber=when(4, 0, k.cast("string")), addr__street=when(4, 0, F.lit("A St")), addr__city=when(4, 0, F.lit("Town")),
        proposed=when(10, 7, F.lit("yes")), construction=when(10, 3, F.lit("yes")), disused=when(10, 9, F.lit("yes")), opening_hours=when(8, 0, F.lit("24/7")), website=when(9, 0, F.lit("https://x.example")),
    )
    away, way = k % 17 == 4, k % 2 == 1
    lat, lng = F.when(away, 51.0).otherwise(-33.0 - (k % 100) / 100), F.when(away, 0.0).otherwise(150.0 + (k % 50) / 100)
    lines = _json(c, "c_custkey", type=F.when(k % 19 == 6, "count").when(way, "way").otherwise("node"), id=k, lat=F.when(~way, lat), lon=F.when(~way, lng), center=F.when(way, F.struct(lat.alias("lat"), lng.alias("lon"))), tags=tags)
    return _files(lines, "c_custkey", '{"osm3s":{"timestamp_osm_base":"2026-09-04T00:00:00Z"},"elements":[', ",", "]}")


@query("source_osm", """WITH e AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 19 <> 6 AND c_custkey % 17 <> 4)
SELECT CASE k % 2 WHEN 1 THEN 'way/' ELSE 'node/' END || k AS id, round(-33.0 - (k % 100) / 100.0, 2) AS lat, round(150.0 + (k % 50) / 100.0, 2) AS lng, CASE WHEN k % 3 = 0 THEN 'Hub ' || k WHEN k % 4 = 1 THEN 'chargefox' ELSE 'Evie' END AS name, k % 3 <> 0 AS name_from_operator,
  CASE WHEN k % 4 = 1 THEN 'Chargefox' ELSE 'Evie Networks' END AS operator, CASE WHEN k % 4 = 1 THEN 'Chargefox' END AS network, CAST((k % 2 = 0)::INT + (k % 3 = 0)::INT AS INT) AS standards, CASE WHEN k % 2 = 0 THEN 350.0 END AS max_power_kw, CAST(CASE WHEN k % 6 = 1 THEN 4 END AS INT) AS plug_count,
  CASE k % 10 WHEN 3 THEN 'construction' WHEN 7 THEN 'planned' WHEN 9 THEN 'decommissioned' ELSE 'operational' END AS status, CASE WHEN k % 5 = 0 THEN 'restricted' ELSE 'unknown' END AS access, CASE WHEN k % 2 = 0 THEN true WHEN k % 7 = 0 THEN false END AS fee,
  CASE WHEN k % 4 = 0 THEN 'Town' END AS suburb, CASE WHEN k % 4 = 0 THEN k || ' A St' END AS street, CASE WHEN k % 8 = 0 THEN '24/7' END AS opening_hours, CASE WHEN k % 9 = 0 THEN 'https://x.example' END AS website FROM e""")
def source_osm(spark, d):
    r = _id("osm").read(spark, _osm(spark, d), CTX)[0]
    return r.select(F.col("source_record_id").alias("id"), F.round("lat", 2).alias("lat"), F.round("lng", 2).alias("lng"), "name", "name_from_operator", "operator", "network", F.size("connectors").alias("standards"), "max_power_kw", "plug_count", "status", "access", "fee", "address.suburb", "address.street", "opening_hours", "website")


@query("source_osm_rejected", "SELECT CASE c_custkey % 2 WHEN 1 THEN 'way/' ELSE 'node/' END || c_custkey AS id FROM customer WHERE c_custkey % 19 <> 6 AND c_custkey % 17 = 4")
def source_osm_rejected(spark, d):
    return _id("osm").read(spark, _osm(spark, d), CTX)[1].select(F.col("source_record_id").alias("id"))


# --- VIC -----------------------------------------------------------------------
def _vic(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    due = F.element_at(F.array(F.lit("31/07/2023"), F.lit("December 2026"), F.lit("soon"), F.lit(None), F.lit("5 September 2026")), (k % 5 + 1).cast("int"))
    p = _tags(
        location=F.concat(F.lit("Place "), k.cast("string")), company=F.when(k % 2 == 0, "Chargefox"), lead_organisation=F.when(k % 3 == 0, F.concat(F.lit("Shire "), k.cast("string"))), address=F.concat(k.cast("string"), F.lit(" A St, Tatura")),
        plug_type=F.when(k % 4 == 0, "1 x CHAdeMO and 1 x CCS2/SAE").when(k % 4 == 1, "2 x Type 2").when(k % 4 == 2, "??"), chargers=F.when(k % 2 == 0, "1 x 50kW Charger").otherwise("2 x 22kW"), number_of_chargers=F.concat((k % 4 + 1).cast("string"), F.lit(".0")), estimated_project_completion=due,
        longitude=F.lit("144.5"), latitude=F.lit("-37.5"),
    )
    place = F.when(k % 6 != 0, F.struct(F.array(F.lit(145.0), F.when(k % 11 == 3, 10.0).otherwise(-37.0 - (k % 100) / 100)).alias("coordinates")))
    lines = _json(c, "c_custkey", type=F.lit("Feature"), id=F.when(k % 7 != 0, k.cast("string")), geometry=place, properties=p)
    return _files(lines, "c_custkey", '{"type":"FeatureCollection","features":[', ",", "]}")


VIC_SQL = """v AS (SELECT c_custkey AS k, 'dcav:' || CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'place-' || c_custkey END AS id, c_custkey % 11 = 3 AND c_custkey % 6 <> 0 AS bad,
  CASE c_custkey % 5 WHEN 1 THEN 'planned' WHEN 2 THEN 'unknown' ELSE 'operational' END AS status FROM customer)"""


@query("source_vic", f"""WITH {VIC_SQL} SELECT id, CASE WHEN k % 6 = 0 THEN -37.5 ELSE round(-37.0 - (k % 100) / 100.0, 2) END AS lat, CASE WHEN k % 6 = 0 THEN 144.5 ELSE 145.0 END AS lng, CASE WHEN k % 3 = 0 THEN 'Shire ' || k ELSE 'Place ' || k END AS name,
  CASE WHEN k % 2 = 0 THEN 'Chargefox' WHEN k % 3 = 0 THEN 'Shire ' || k END AS operator, 'VIC' AS state, 'Tatura' AS suburb, CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS standards, CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS INT) AS connector_plugs,
  CASE WHEN k % 2 = 0 THEN 50.0 ELSE 22.0 END AS max_power_kw, CAST(k % 4 + 1 AS INT) AS plug_count, status FROM v WHERE NOT bad""")
def source_vic(spark, d):
    r = _id("vic").read(spark, _vic(spark, d), CTX)[0]
    return r.select(F.col("source_record_id").alias("id"), F.round("lat", 2).alias("lat"), "lng", "name", "operator", "address.state", "address.suburb", F.size("connectors").alias("standards"), _sum(F.col("connectors")).alias("connector_plugs"), "max_power_kw", "plug_count", "status")


@query("source_vic_issues", f"""WITH {VIC_SQL} SELECT id, 'rejected' AS kind FROM v WHERE bad UNION ALL SELECT id, 'parse_failure' FROM v WHERE NOT bad AND k % 4 = 2 UNION ALL SELECT id, 'parse_failure' FROM v WHERE NOT bad AND k % 5 = 2 UNION ALL SELECT id, 'status_flag' FROM v WHERE NOT bad AND status = 'planned'""")
def source_vic_issues(spark, d):
    return _id("vic").read(spark, _vic(spark, d), CTX)[1].select(F.col("source_record_id").alias("id"), "kind")


# --- Open Charge Map --------------------------------------------------------------
def _ocm(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    plugs = F.array(F.struct(F.struct(F.when(k % 2 == 0, "CCS (Type 2)").otherwise("").alias("Title")).alias("ConnectionType"), F.lit(25).alias("ConnectionTypeID"), (k % 3).cast("int").alias("Quantity"), F.when(k % 4 != 0, F.lit(50.0)).alias("PowerKW")))
    lines = _json(
        s, "s_suppkey", ID=k, AddressInfo=F.struct(F.when(k % 9 == 2, 10.0).otherwise(-33.0 - (k % 50) / 100).alias("Latitude"), F.lit(151.0).alias("Longitude"), F.col("s_name").alias("Title"), F.lit("Town").alias("Town"), F.lit("2000").alias("Postcode")), Connections=plugs,
        OperatorInfo=F.struct(F.lit("Tesla Motors").alias("Title")), StatusType=F.struct(F.when(k % 5 == 0, "Planned For Future Date").alias("Title"), (k % 2 == 0).alias("IsOperational")), UsageType=F.struct(F.when(k % 3 == 0, "Public").otherwise("Private").alias("Title"), (k % 3 == 1).alias("IsPayAtLocation")),
        UsageCost=F.when(k % 6 == 0, "$1"), NumberOfPoints=(k % 8).cast("int"), DataProvider=F.struct(F.lit("P").alias("Title"), (k % 10 != 7).alias("IsOpenDataLicensed")),
    )
    return _id("ocm").read(spark, _files(lines, "s_suppkey", "[", ",", "]"), CTX)


@query("source_ocm", """SELECT 'ocm:' || s_suppkey AS id, s_name AS name, round(-33.0 - (s_suppkey % 50) / 100.0, 2) AS lat, 'Tesla' AS operator, CAST((s_suppkey % 2 = 0)::INT AS INT) AS standards, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 50.0 END AS max_power_kw, CAST(s_suppkey % 8 AS INT) AS plug_count,
  CASE WHEN s_suppkey % 5 = 0 THEN 'planned' WHEN s_suppkey % 2 = 0 THEN 'operational' ELSE 'unknown' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 'public' ELSE 'private' END AS access, CASE WHEN s_suppkey % 6 = 0 THEN true ELSE s_suppkey % 3 = 1 END AS fee, 'Town' AS suburb, '2000' AS postcode
FROM supplier WHERE s_suppkey % 9 <> 2 AND s_suppkey % 10 <> 7""")
def source_ocm(spark, d):
    return _ocm(spark, d)[0].select(F.col("source_record_id").alias("id"), "name", F.round("lat", 2).alias("lat"), "operator", F.size("connectors").alias("standards"), "max_power_kw", "plug_count", "status", "access", "fee", "address.suburb", "address.postcode")


@query("source_ocm_issues", "SELECT 'ocm:' || s_suppkey AS id, CASE WHEN s_suppkey % 9 = 2 THEN 'rejected' ELSE 'policy' END AS kind FROM supplier WHERE s_suppkey % 9 = 2 OR s_suppkey % 10 = 7")
def source_ocm_issues(spark, d):
    return _ocm(spark, d)[1].select(F.col("source_record_id").alias("id"), "kind")


# --- pages without coordinates ------------------------------------------------------
def _act_page(spark, d, bays: int = 0) -> str:
    """Charger tables of the districts, one row a nation; ``bays`` is added to the stated total."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25
    of = lambda n: [r for r in rows if r.n_nationkey % len(ACT_DISTRICTS) == n]
    line = lambda r: f"<tr><td>1</td><td>{2 + r.n_nationkey % 4}</td><td>{('22kW AC', '?', '50 kW DC')[r.n_nationkey % 3]}</td><td>Type&nbsp;2 or CHAdeMO</td><td>Venue {r.n_name}, {r.n_nationkey} Main Way, Canberra</td></tr>"
    head = "<tr><th>Number of chargers</th><th>Number of charging bays</th><th>Charger type</th><th>Plug type</th><th>Location</th></tr>"
    tables = "".join(f"<button class='b'><span>{name}</span></button><table>{head}{''.join(map(line, of(n)))}</table>" for n, name in enumerate(ACT_DISTRICTS))
    total = sum(2 + r.n_nationkey % 4 for r in rows) + bays
    return f"<html><p>As of December 2025, {len(rows)} public EV chargers with {total} charging bays have received funding</p>{tables}</html>"


def _act_cache(spark, d) -> DataFrame:
    """Places of two thirds of the nations, null for the second third."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    place = F.struct((-35.2 - k / 1000).alias("lat"), F.lit(149.1).alias("lng"), F.lit("m").alias("display_name"), F.lit("t").alias("type"))
    return n.where(k % 3 != 2).select(F.concat(k.cast("string"), F.lit(" main way canberra")).alias("key"), F.when(k % 3 == 0, place).alias("result"))


def _with(geocodes: DataFrame) -> Context:
    return Context(CTX.fetched_at, CTX.as_of, geocodes)


@query("source_act", f"""SELECT lower('act:' || regexp_replace(({list(ACT_DISTRICTS)!r})[n_nationkey % 7 + 1], ' ', '-') || ':venue-' || replace(n_name, '_', '-')) AS id, 'Venue ' || n_name AS name, ({list(ACT_DISTRICTS)!r})[n_nationkey % 7 + 1] AS district, round(-35.2 - n_nationkey / 1000.0, 4) AS lat, 'ACT' AS state, 'Canberra' AS suburb,
  CAST(2 + n_nationkey % 4 AS INT) AS plug_count, CASE n_nationkey % 3 WHEN 0 THEN 22.0 END AS max_power_kw, 2 AS standards, true AS geocoded FROM nation WHERE n_nationkey % 3 = 0""")
def source_act(spark, d):
    r = _id("act").read(spark, _page(spark, _act_page(spark, d)), _with(_act_cache(spark, d)))[0]
    return r.select(F.col("source_record_id").alias("id"), "name", F.element_at("extra", "district").alias("district"), F.round("lat", 4).alias("lat"), "address.state", "address.suburb", "plug_count", "max_power_kw", F.size("connectors").alias("standards"), "geocoded")


@query("source_act_issues", """SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'status_flag' ELSE 'rejected' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'not found' ELSE 'never asked' END AS why, count(*) AS n FROM nation GROUP BY ALL""")
def source_act_issues(spark, d):
    i = _id("act").read(spark, _page(spark, _act_page(spark, d)), _with(_act_cache(spark, d)))[1]
    why = F.when(F.col("issue").contains("not in the geocode cache"), "never asked").when(F.col("issue").contains("found no coordinate"), "not found").otherwise("kept")
    return i.groupBy("kind", why.alias("why")).agg(F.count("*").alias("n"))


TAS_KINDS = ("Fast", "Destination", "Workplace")


def _tas_page(spark, d, more: int = 0) -> str:
    """Three grant tables, one row a nation in each; ``more`` is added to the first stated total."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25
    note = ("", " (two chargers)", " (3 chargers)")
    line = lambda r: f"<tr><td>{r.n_name} Council{note[r.n_nationkey % 3]}</td><td>Town {r.n_nationkey}{' (Upgrade)' if r.n_nationkey % 2 else ''}</td><td>North</td><td>${r.n_nationkey + 1},000</td></tr>"
    sums = sum(r.n_nationkey + 1 for r in rows)
    table_ = lambda extra: f"<table><tr><th>Organisation</th><th>Location</th><th>Region</th><th>Amount</th></tr>{''.join(map(line, rows))}<tr><td>Total</td><td></td><td></td><td>${sums + extra},000</td></tr></table>"
    return "".join(f"<h3>{k} charging grants</h3>{table_(more if k == 'Fast' else 0)}" for k in TAS_KINDS)


def _tas_cache(spark, d) -> DataFrame:
    """Towns of the state, every fifth one elsewhere."""
    k = F.col("n_nationkey")
    place = F.struct(F.when(k % 5 == 4, -33.0).otherwise(-41.0 - k / 100).alias("lat"), F.lit(147.0).alias("lng"), F.lit("m").alias("display_name"), F.lit("t").alias("type"))
    return table(spark, d, "nation").select(F.concat(F.lit("town "), k.cast("string")).alias("key"), place.alias("result"))


@query("source_tas", """WITH g AS (SELECT unnest(['Fast', 'Destination', 'Workplace']) AS grant_kind) SELECT grant_kind || ' charging grants' AS round, n_name || ' Council — Town ' || n_nationkey AS name, n_name || ' Council' AS operator, 'Town ' || n_nationkey AS suburb, round(-41.0 - n_nationkey / 100.0, 4) AS lat,
  CASE grant_kind WHEN 'Fast' THEN 'DCUnspecified' ELSE 'ACUnspecified' END AS standard, CAST(CASE n_nationkey % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INT) AS plug_count, 'geocoded_locality' AS position_precision, 1000.0 * (n_nationkey + 1) AS amount, CASE WHEN n_nationkey % 2 = 1 THEN 'Upgrade' END AS qualifier
FROM nation, g WHERE n_nationkey % 5 <> 4""")
def source_tas(spark, d):
    r = _id("tas").read(spark, _page(spark, _tas_page(spark, d)), _with(_tas_cache(spark, d)))[0]
    return r.select(F.element_at("extra", "round").alias("round"), "name", "operator", "address.suburb", F.round("lat", 4).alias("lat"), F.get("connectors", F.lit(0))["standard"].alias("standard"), "plug_count", "position_precision", F.element_at("extra", "amount").cast("double").alias("amount"), F.try_element_at("extra", F.lit("qualifier")).alias("qualifier"))


@query("source_tas_issues", "SELECT 'rejected' AS kind, 3 * count(*) FILTER (WHERE n_nationkey % 5 = 4) AS n FROM nation UNION ALL SELECT 'status_flag', 3 * count(*) FILTER (WHERE n_nationkey % 5 <> 4) FROM nation UNION ALL SELECT 'data_gap', 3 * count(*) FILTER (WHERE n_nationkey % 5 <> 4) FROM nation")
def source_tas_issues(spark, d):
    return _id("tas").read(spark, _page(spark, _tas_page(spark, d)), _with(_tas_cache(spark, d)))[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("addresses_to_geocode", "SELECT n_nationkey || ' Main Way, Canberra' AS address, n_nationkey || ' main way canberra' AS key FROM nation WHERE n_nationkey % 3 = 2")
def addresses_to_geocode(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" Main Way, Canberra")).alias("address"))
    return lookup.addresses_to_geocode(n.unionAll(n), _act_cache(spark, d), "address")


@query("geocode_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS resolved, count(*) FILTER (WHERE n_nationkey % 3 = 1) AS unresolved FROM nation WHERE n_nationkey % 3 <> 2")
def geocode_stats(spark, d):
    return rollups.geocode_stats(_act_cache(spark, d)).select("total", "resolved", "unresolved")


# --- gates ---------------------------------------------------------------------
@query("source_gates", """WITH t AS (SELECT count(*) AS rows, sum(n_nationkey + 1) AS grants FROM nation)
SELECT source_id, given, why FROM (VALUES ('osm', 'good', NULL), ('osm', 'old', 'data is more than 7 days old'), ('osm', 'empty', 'no elements'), ('osm', 'remark', 'remark: timed out'), ('vic', 'good', NULL), ('vic', 'error page', 'not a FeatureCollection with features'),
  ('qld', 'good', NULL), ('qld', 'error page', 'refused'), ('act', 'good', NULL), ('act', 'other total', 'refused'), ('act', 'no tables', 'expected 7 district tables, found 0'), ('tas', 'good', NULL), ('tas', 'no tables', 'expected 3 tables with a Location column, found 0')) v(source_id, given, why)
UNION ALL SELECT 'tas', 'other total', 'parsed grants sum to ' || grants || '000.0 but the page states ' || (grants + 1) || '000.0' FROM t""")
def source_gates(spark, d):
    osm = lambda at, elements, remark="": _page(spark, f'{{"osm3s":{{"timestamp_osm_base":"{at}"}},{remark}"elements":[{elements}]}}')
    node, error = '{"type":"node","id":1,"lat":-33.0,"lon":151.0,"tags":{}}', "<html><body>Service unavailable</body></html>"
    cases = (
        ("osm", "good", osm("2026-09-04T00:00:00Z", node)), ("osm", "old", osm("2026-08-01T00:00:00Z", node)), ("osm", "empty", osm("2026-09-04T00:00:00Z", "")), ("osm", "remark", osm("2026-09-04T00:00:00Z", node, '"remark":"timed out",')),
        ("vic", "good", _vic(spark, d)), ("vic", "error page", _page(spark, error)), ("qld", "good", _page(spark, "Location Name,Latitude,Longitude\na,-27.5,153.0")), ("qld", "error page", _page(spark, error)),
        ("act", "good", _page(spark, _act_page(spark, d))), ("act", "other total", _page(spark, _act_page(spark, d, 1))), ("act", "no tables", _page(spark, error)),
        ("tas", "good", _page(spark, _tas_page(spark, d))), ("tas", "other total", _page(spark, _tas_page(spark, d, 1))), ("tas", "no tables", _page(spark, error)),
    )
    rows = [(s, given, _id(s).validate(spark, path, CTX)) for s, given, path in cases]
    plain = {("qld", "error page"), ("act", "other total")}
    return spark.createDataFrame([(s, g, "refused" if w and (s, g) in plain else w) for s, g, w in rows], "source_id string, given string, why string")


@query("source_catalogue", """SELECT * FROM (VALUES ('osm', 'ODbL 1.0', true, false, true), ('nsw', 'CC BY 4.0', false, false, true), ('vic', 'CC BY 4.0', false, false, true), ('qld', 'CC BY 4.0', false, false, true), ('act', 'CC BY 4.0', false, true, true), ('tas', 'CC BY 3.0 AU', false, true, true), ('ocm', 'CC BY 4.0', false, false, false))
v(source_id, licence, share_alike, requires_geocoding, on_by_default)""")
def source_catalogue(spark, d):
    return sources.catalogue(spark).select("source_id", "licence", "share_alike", "requires_geocoding", "on_by_default")


@query("attribution", "SELECT * FROM (VALUES ('osm', 'ODbL 1.0', true), ('tas', 'CC BY 3.0 AU', false), ('geocoding', 'ODbL 1.0', true)) v(source_id, licence, share_alike)")
def attribution(spark, d):
    return sources.attribution(spark, ["osm", "tas"]).select("source_id", "licence", "share_alike")


@query("reconciled_totals", "SELECT o_orderkey % 7 = 0 AS odd, bool_and(true) AS told FROM orders GROUP BY 1")
def reconciled_totals(spark, d):
    """Sums that the totals stated by a source must equal."""
    o = table(spark, d, "orders")
    said = o.agg(F.count("*").alias("n")).first().asDict()
    one = F.lit(1).cast("long")
    ok, other = quality.totals_match(o, {"n": one}, said), quality.totals_match(o, {"n": one}, {"n": said["n"] + 1})
    return spark.createDataFrame([(True, ok is None), (False, other is not None)], "odd boolean, told boolean")


# --- the whole run ----------------------------------------------------------------
@query("ingest_report", f"""WITH {NSW_SQL},
r AS (SELECT 'nsw' AS source_id, count(*) FILTER (WHERE k % 13 <> 5) AS record_count, count(*) FILTER (WHERE k % 13 <> 5 AND kind = 'upcoming') AS planned_count, count(*) FILTER (WHERE k % 13 = 5) AS structural_count,
    count(*) FILTER (WHERE k % 13 = 5) + count(*) FILTER (WHERE k % 13 <> 5 AND rating = 3) + count(*) FILTER (WHERE k % 13 <> 5 AND kind = 'upcoming') AS issue_count, NULL AS error FROM n
  UNION ALL SELECT 'qld', count(*) FILTER (WHERE s_suppkey % 7 <> 3), count(*) FILTER (WHERE s_suppkey % 7 <> 3 AND s_suppkey % 3 = 1), count(*) FILTER (WHERE s_suppkey % 7 = 3), count(*) FILTER (WHERE s_suppkey % 7 = 3 OR s_suppkey % 4 = 0), NULL FROM supplier
  UNION ALL SELECT 'vic', NULL, NULL, NULL, NULL, 'not a FeatureCollection with features')
SELECT * FROM r""")
def ingest_report(spark, d):
    """Two sources and one that is refused: the run goes on and says why."""
    from geoloom import ingest

    run = ingest.ingest(spark, {"nsw": _nsw_file(spark, d), "qld": _qld_file(spark, d), "vic": _page(spark, "<html>Service unavailable</html>")}, CTX)
    return run.source_stats.select("source_id", "record_count", "planned_count", "structural_count", "issue_count", "error")


@query("dataset_round_trip", """SELECT round(-27.0 - (s_suppkey % 90) / 100.0, 2) AS lat, count(DISTINCT s_suppkey) AS records, bool_or(s_suppkey % 3 = 1) AS any_planned FROM supplier WHERE s_suppkey % 7 <> 3 GROUP BY 1""")
def dataset_round_trip(spark, d):
    """A run written and read again: one site a place, with the records that make it."""
    from geoloom import ingest

    path = shared_dir(spark)
    ingest.save(ingest.ingest(spark, {"qld": _qld_file(spark, d)}, CTX), path)
    s, r = ingest.load(spark, path), ingest.load(spark, path, "records")
    planned = r.groupBy(F.round("lat", 2).alias("lat")).agg(F.bool_or(F.col("status") == "planned").alias("any_planned"))
    return s.select(F.round("lat", 2).alias("lat"), F.size("sources").cast("long").alias("records")).join(planned, "lat")

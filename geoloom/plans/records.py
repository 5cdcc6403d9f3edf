"""Tables and the derived records view that exercise the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About three records per place, 28 to 59 m apart, made from orders, customers and parts."""
    o, c, p = (table(spark, sf_dir, n) for n in ("orders", "customer", "part"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(p, p.p_partkey == o.o_orderkey % 200)
    k = F.col("o_orderkey")
    third, rest = F.expr("o_orderkey div 3"), k % 3
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return j.select(
        k.alias("rid"), pick(("osm", "nsw", "vic"), rest).alias("source_id"),
        (F.lit(-38.0) + (third % 400) * F.lit(0.025) + rest * F.lit(0.0002)).alias("lat"),
        (F.lit(141.0) + F.expr("(o_orderkey div 3) div 400") * F.lit(0.05) + rest * F.lit(0.0002)).alias("lng"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("operator"),
        F.when(k % 4 != 0, F.col("p_name")).alias("name"),
        pick((None, 3.0, 7.0, 22.0, 50.0, 150.0, 350.0), k % 7).cast("double").alias("max_power_kw"),
        F.when(F.col("o_orderstatus") == "F", "operational").when(F.col("o_orderstatus") == "P", "planned").otherwise("unknown").alias("status"),
        F.col("o_orderdate").alias("fetched_at"),
    )


def in_country(r: DataFrame) -> DataFrame:
    """The records with longitudes of the country: those beyond its box go back by widths of the box."""
    _, _, west, east = geo.COUNTRY_BOX
    return r.withColumn("lng", F.when(F.col("lng") > east, F.lit(west) + F.pmod(F.col("lng") - west, F.lit(east - west))).otherwise(F.col("lng")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the derived columns of sites, one site a record."""
    r = records(spark, sf_dir)
    return r.withColumns({
        "id": F.col("rid"), "display_name": F.coalesce("name", "operator", F.lit("Charging site")), "state": geo.state_of(F.col("lat"), F.col("lng")),
        "speed_band": text.speed_band(F.col("max_power_kw")), "source_count": (F.col("rid") % 3 + 1).cast("int"), "confidence": F.round(F.lit(0.2) + (F.col("rid") % 8) * F.lit(0.1), 3),
        "position_precision": F.when(F.col("rid") % 11 == 0, text.BY_LOCALITY).when(F.col("rid") % 5 == 0, text.BY_ADDRESS).otherwise(text.SURVEYED),
        "plug_count": F.when(F.col("rid") % 6 != 0, (F.col("rid") % 9).cast("int")),
    })


#: The same views for DuckDB, as common table expressions.
REC_SQL = """
rec AS (
  SELECT o_orderkey AS rid, (['osm', 'nsw', 'vic'])[o_orderkey % 3 + 1] AS source_id,
    -38.0::DOUBLE + ((o_orderkey // 3) % 400) * 0.025::DOUBLE + (o_orderkey % 3) * 0.0002::DOUBLE AS lat,
    141.0::DOUBLE + ((o_orderkey // 3) // 400) * 0.05::DOUBLE + (o_orderkey % 3) * 0.0002::DOUBLE AS lng,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS operator,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE p_name END AS name,
    CAST(([NULL, 3, 7, 22, 50, 150, 350])[o_orderkey % 7 + 1] AS DOUBLE) AS max_power_kw,
    CASE o_orderstatus WHEN 'F' THEN 'operational' WHEN 'P' THEN 'planned' ELSE 'unknown' END AS status,
    o_orderdate AS fetched_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 200)"""
BAND_SQL = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 'unknown' WHEN {0} < 7 THEN 'trickle' WHEN {0} < 25 THEN 'slow' WHEN {0} < 50 THEN 'medium' WHEN {0} < 150 THEN 'fast' WHEN {0} < 250 THEN 'rapid' ELSE 'ultra' END"
STATE_SQL = (
    "CASE WHEN NOT ({0} BETWEEN -44 AND -9 AND {1} BETWEEN 112 AND 154.5) THEN NULL WHEN {0} BETWEEN -35.95 AND -35.1 AND {1} BETWEEN 148.75 AND 149.4 THEN 'ACT' "
    "WHEN {1} < 129 THEN 'WA' WHEN {0} < -39.5 THEN 'TAS' WHEN {1} < 141 AND {0} > -26 THEN 'NT' WHEN {1} < 141 THEN 'SA' WHEN {0} > -29 THEN 'QLD' WHEN {0} < -34 AND {1} < 150 THEN 'VIC' ELSE 'NSW' END"
)
SITES_SQL = REC_SQL + f""",
sites AS (
  SELECT *, rid AS id, coalesce(name, operator, 'Charging site') AS display_name, {STATE_SQL.format("lat", "lng")} AS state, {BAND_SQL.format("max_power_kw")} AS speed_band,
    CAST(rid % 3 + 1 AS INT) AS source_count, round(0.2 + (rid % 8) * 0.1, 3) AS confidence,
    CASE WHEN rid % 11 = 0 THEN 'geocoded_locality' WHEN rid % 5 = 0 THEN 'geocoded_address' ELSE 'surveyed' END AS position_precision,
    CASE WHEN rid % 6 = 0 THEN NULL ELSE CAST(rid % 9 AS INT) END AS plug_count
  FROM rec)"""
HAVERSINE_SQL = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in text.GENERIC_NAME_WORDS) + "]"
TOKENS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains(" + GENERIC_SQL + ", t)))"
SIM_SQL = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE END"
LNG_STEP = f"(250.0 / ({geo.METRES_PER_DEGREE!r} * greatest(0.2, cos(radians(lat)))))"
KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[‘’''`]', '', 'g'), '\\b(" + "|".join(text.COMPANY_WORDS) + ")\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"

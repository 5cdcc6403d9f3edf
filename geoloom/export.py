"""Export sinks: CSV, GeoJSON, JSON and the share-alike bundle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import text
from geoloom.sources import tabular

CSV_COLUMNS = [
    "id", "name", "display_name", "operator", "network", "lat", "lng", "state", "street", "suburb", "postcode", "status", "access", "fee", "plug_count", "max_power_kw",
    "speed_band", "connectors", "source_count", "sources", "confidence", "spatial_spread_m", "conflict_fields",
]


def csv_rows(sites: DataFrame) -> DataFrame:
    """The flat columns of the CSV export, all text."""
    number = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\.0$", "")
    special = {
        "street": F.col("address.street"), "suburb": F.col("address.suburb"), "postcode": F.col("address.postcode"), "plug_count": number("plug_count"), "max_power_kw": number("max_power_kw"),
        "lat": number("lat"), "lng": number("lng"), "confidence": number("confidence"),
        "connectors": F.array_join(F.transform("connectors", text.connector_label), "; "), "sources": F.array_join(F.transform("sources", lambda s: s["source_id"]), "+"), "conflict_fields": F.array_join(F.array_sort(F.map_keys("conflicts")), "; "),
    }
    return sites.select(*[F.coalesce(special.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def attribution_lines(meta: dict, prefix: str = "# ") -> list[str]:
    """Header lines that travel with a CSV: generation time, licence, required attribution."""
    own = [f"{prefix}  - {a['text']} ({a['licence']}) {a['licence_url']}" for a in meta.get("attribution", [])]
    return [f"{prefix}geoloom export, generated {meta['generated_at']}", f"{prefix}Effective licence: {meta['licence']}", f"{prefix.rstrip()}", f"{prefix}Sources and required attribution:", *own, f"{prefix.rstrip()}"]


def csv_lines(sites: DataFrame) -> DataFrame:
    """(value): CSV lines in the order of the ids, without the header."""
    return tabular.csv_lines(csv_rows(sites).orderBy("id"), CSV_COLUMNS)


def geojson_features(sites: DataFrame) -> DataFrame:
    """(id, value): one GeoJSON feature a site."""
    props = F.struct(*[F.col(c) for c in ("id", "name", "operator", "network", "state", "status", "access", "fee", "plug_count", "max_power_kw", "speed_band", "source_count", "confidence", "spatial_spread_m")], F.col("connectors"), F.array_join(F.transform("sources", lambda s: s["source_id"]), "+").alias("sources"), F.array_sort(F.map_keys("conflicts")).alias("conflict_fields"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))
    return sites.orderBy("id").select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def json_lines(sites: DataFrame) -> DataFrame:
    """(id, value): one object a site."""
    return sites.orderBy("id").select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def slim(sites: DataFrame) -> DataFrame:
    """The projection for a browser: flat address, conflict field names, source ids, provenance sources, latest fetch."""
    return sites.select(
        "id", "name", "display_name", "operator", "lat", "lng", "state", F.col("address.full").alias("address"), F.col("address.suburb").alias("suburb"), F.col("address.postcode").alias("postcode"), "status", "access", "fee", "plug_count", "max_power_kw", "speed_band", "connectors", "source_count", "confidence",
        F.map_keys("conflicts").alias("conflicts"), F.transform("sources", lambda s: s["source_id"]).alias("sources"), F.transform_values("provenance", lambda k, v: v["source_id"]).alias("provenance"), F.array_max(F.transform("sources", lambda s: s["fetched_at"])).alias("fetched_at"),
    )


def json_documents(lines: DataFrame, order: str = "id") -> DataFrame:
    """Lines (order, value) of JSON values as members of one array: every one but the first starts with a comma."""
    least = lines.agg(F.min(order)).first()[0]
    return lines.orderBy(order).select(F.concat(F.when(F.col(order) == F.lit(least), "").otherwise(","), "value").alias("value"))


def _parts(sites: DataFrame, fmt: str, meta: dict) -> tuple[list[str], DataFrame, list[str]]:
    """(first lines, lines of rows, last lines): one after the other they are a whole document."""
    if fmt == "csv":
        return [*attribution_lines(meta), tabular.csv_header(CSV_COLUMNS)], csv_lines(sites), []
    told = json.dumps(meta, ensure_ascii=False, default=str)
    if fmt == "geojson":
        return [f'{{"type":"FeatureCollection","metadata":{told},"features":['], json_documents(geojson_features(sites)), ["]}"]
    rows = json_documents(json_lines(slim(sites) if fmt == "slim" else sites))
    return [f'{{"meta":{told},"sites":['], rows, ["]}"]


FORMATS = ("csv", "geojson", "json", "slim")


def write(sites: DataFrame, fmt: str, path: str, meta: dict) -> list[str]:
    """Write one format (csv, geojson, json, slim) or all but slim (bundle) as text parts under ``path``; returns the folders.

    The folders ``0-head``, ``1-rows`` and ``2-tail`` hold the parts, so no
    writer gathers all rows in one task; in the order of their names they are one
    valid document, which ``join_parts`` puts together.
    """
    spark = sites.sparkSession
    if fmt != "bundle" and fmt not in FORMATS:
        raise ValueError(f"unknown export format {fmt!r}; one of {', '.join([*FORMATS, 'bundle'])}")
    put = lambda lines, at: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(at)
    out = []
    for f in FORMATS[:3] if fmt == "bundle" else [fmt]:
        head, rows, tail = _parts(sites, f, meta)
        put(head, f"{path}/{f}/0-head")
        rows.write.mode("overwrite").text(f"{path}/{f}/1-rows")
        put(tail, f"{path}/{f}/2-tail")
        out.append(f"{path}/{f}")
    if fmt == "bundle":
        put([f"This database is offered under {meta['licence']}.", *attribution_lines(meta, "")], f"{path}/notice/0-head")
        out.append(f"{path}/notice")
    return out


def join_parts(spark, folders: list[str], file: str) -> None:
    """One file of the parts of the folders, copied as streams in the order of their names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = at(file)
    with_out = target.getFileSystem(conf).create(target, True)
    try:
        for folder in folders:
            fs = at(folder).getFileSystem(conf)
            for kind in sorted(str(x.getPath()) for x in fs.listStatus(at(folder))):
                for part in sorted(str(x.getPath()) for x in fs.listStatus(at(kind)) if x.getPath().getName().startswith("part-")):
                    stream = fs.open(at(part))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, with_out, conf, False)
                    finally:
                        stream.close()
    finally:
        with_out.close()

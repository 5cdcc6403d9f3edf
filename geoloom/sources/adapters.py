"""The seven adapters: raw files to records and issues, as DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo, text
from geoloom.operators import lookup, quality
from geoloom.schema import CONNECTORS, ISSUE, RECORD, conform
from geoloom.sources import html, tabular


@dataclass(frozen=True)
class Context:
    """What a run knows: fetch time and the date that counts as today, both explicit."""

    fetched_at: str
    as_of: str
    geocodes: DataFrame | None = None
    options: dict = field(default_factory=dict)


class Source(ABC):
    """One publisher's data; ``stage`` gives record columns, ``_why`` and ``_issues`` per row."""

    id: str
    name: str
    licence: str
    licence_url: str
    attribution_required = True
    share_alike = False
    requires_geocoding = False
    homepage = ""

    @abstractmethod
    def stage(self, spark: SparkSession, path: str, ctx: Context) -> DataFrame: ...

    def validate(self, spark: SparkSession, path: str, ctx: Context) -> str | None:
        """Why the raw file must not be used, or None."""
        return quality.expect_rows(self.stage(spark, path, ctx))

    def read(self, spark: SparkSession, path: str, ctx: Context) -> tuple[DataFrame, DataFrame]:
        """(records, issues)."""
        d = self.stage(spark, path, ctx)
        d = d.withColumns({"source_id": F.lit(self.id), "fetched_at": F.lit(ctx.fetched_at).cast("timestamp")})
        if "source_url" not in d.columns:
            d = d.withColumn("source_url", F.lit(self.homepage))
        good = d.where(F.col("_why").isNull())
        kept = good.withColumn("rid", F.coalesce(F.xxhash64("source_id", "source_record_id"), F.lit(0)))
        shape = "array<struct<kind:string,issue:string>>"
        own = F.when(F.col("_why").isNotNull(), F.array(F.struct(F.coalesce(F.col("_kind") if "_kind" in d.columns else F.lit("rejected"), F.lit("rejected")).alias("kind"), F.col("_why").alias("issue"))).cast(shape)).otherwise(F.col("_issues").cast(shape) if "_issues" in d.columns else F.array().cast(shape))
        issues = d.select("source_id", "source_record_id", F.explode(own).alias("i")).select("source_id", "source_record_id", "i.kind", "i.issue")
        return conform(kept, RECORD), conform(issues, ISSUE)


def _issues(*pairs: tuple[str, Column, Column]) -> Column:
    """array of (kind, issue) for which the condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), m.alias("issue"))) for k, c, m in pairs]))


def _whole(x: Column) -> Column:
    return F.when(F.trim(text.text_of(x)).rlike("^[0-9]+$"), F.trim(x.cast("string")).try_cast("int"))


def _place(address: Column, state: str) -> Column:
    return address.withField("state", F.coalesce(address["state"], F.lit(state)))


def _extra(**values: Column) -> Column:
    """A string map of the values that are there."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


def _connectors(*, standard: Column, count: Column, power: Column) -> Column:
    return F.struct(standard.alias("standard"), count.cast("int").alias("count"), power.cast("double").alias("power_kw"))


_AC_CEILING_KW = 43


class Nsw(Source):
    id, name, licence, licence_url = "nsw", "NSW charger register", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"

    def stage(self, spark, path, ctx):
        d = tabular.read_csv(spark, path)
        c = F.col
        lat, lng = c("Latitude").try_cast("double"), c("Longitude").try_cast("double")
        power = text.power_rating(c("Charger_rating"))
        kind = F.lower(F.trim(text.text_of(c("Charger_Type"))))
        std = lambda kw: F.when(kind == "dc", "DCUnspecified").when(kind == "ac", "ACUnspecified").when(kw > _AC_CEILING_KW, "DCUnspecified")
        plugs = _whole(c("Number_of_plugs"))
        rated = F.filter(F.transform("_p.groups", lambda g: _connectors(standard=std(g["kw"]), count=g["count"], power=g["kw"])), lambda x: x["standard"].isNotNull())
        bare = F.array(_connectors(standard=std(F.lit(None).cast("double")), count=plugs, power=F.lit(None)))
        planned = F.contains(kind, F.lit("upcoming"))
        basis = F.concat_ws("|", F.format_string("%.5f", lat), F.format_string("%.5f", lng), text.slug(c("Operator"), 12), text.slug(c("Charger_Type"), 6))
        # rows without an id are told apart by their number among rows of equal content
        twin = F.row_number().over(_window(basis, lat, lng))
        oid = F.nullif(F.trim(text.text_of(c("OBJECTID"))), F.lit(""))
        address = _place(text.address_of(c("Station_address")), "NSW")
        d = d.withColumn("_p", power).withColumn("_a", address)
        code = F.when(F.trim(text.text_of(c("PCODE"))).rlike("^[0-9]{4}$"), F.trim("PCODE"))
        return d.select(
            F.coalesce(F.concat(F.lit("objectid:"), oid), F.concat(F.lit("row:"), F.lower(F.hex(text.fnv1a(basis))), F.lit(":"), twin.cast("string"))).alias("source_record_id"),
            lat.alias("lat"), lng.alias("lng"), text.clean_text(c("Station_name")).alias("name"), text.canonical_operator(c("Operator")).alias("operator"), text.canonical_operator(c("Operator")).alias("network"),
            F.col("_a").withField("postcode", F.coalesce(F.col("_a.postcode"), code)).alias("address"),
            F.when(F.size("_p.groups") > 0, rated).when(kind.isin("ac", "dc"), bare).otherwise(F.array().cast(CONNECTORS)).alias("connectors"),
            plugs.alias("plug_count"), F.col("_p.max_kw").alias("max_power_kw"), F.when(planned, "planned").otherwise("operational").alias("status"), F.lit("unknown").alias("access"),
            _extra(lga=text.clean_text(c("LGANAME")), programme=text.clean_text(c("Source")), charger_type=text.clean_text(c("Charger_Type")), rating_raw=text.clean_text(c("Charger_rating"))).alias("extra"),
            quality.rejection(lat, lng).alias("_why"),
            _issues(
                ("data_gap", F.startswith(F.col("_p.note"), F.lit("states no")), F.concat(F.lit("power: "), F.col("_p.note"))),
                ("parse_failure", F.startswith(F.col("_p.note"), F.lit("cannot read")), F.concat(F.lit("power: "), F.col("_p.note"))),
                ("status_flag", planned, F.lit("not built yet: Charger_Type says Upcoming")),
            ).alias("_issues"),
        )

    @staticmethod
    def newest_resource(package: DataFrame, number: Column | None = None) -> DataFrame:
        """url of the newest CSV resource of a catalogue entry whose name does not say that it is kept no longer.

        Of those that changed at the same time the first is taken: by the rows' ``number`` where an entry is told in several rows, then by
        the place in its list.
        """
        number = F.lit(0) if number is None else number
        r = package.select(number.alias("number"), F.posexplode("result.resources").alias("place", "r")).where((F.upper("r.format") == "CSV") & ~F.coalesce(F.col("r.name").rlike("(?i)not updated"), F.lit(False)))
        at = F.coalesce(F.nullif("r.last_modified", F.lit("")), "r.created", F.lit(""))
        return r.agg(F.max_by("r.url", F.struct(at, -F.col("number"), -F.col("place"))).alias("url"))


def _window(*cols: Column):
    from pyspark.sql import Window

    return Window.partitionBy(cols[0]).orderBy(*cols[1:])


class Qld(Source):
    id, name, licence, licence_url = "qld", "Queensland electric super highway", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"

    def validate(self, spark, path, ctx):
        return quality.expect_columns(tabular.read_csv(spark, path), "Latitude", "Longitude")

    def stage(self, spark, path, ctx):
        d, c = tabular.read_csv(spark, path), F.col
        lat, lng = c("Latitude").try_cast("double"), c("Longitude").try_cast("double")
        name = text.clean_text(c("Location Name"))
        plugs = F.trim(text.text_of(c("Charging plugs available")))
        return d.select(
            F.concat(F.lit("qesh:"), text.slug(name, 30)).alias("source_record_id"), lat.alias("lat"), lng.alias("lng"), name.alias("name"), text.canonical_operator(c("Host")).alias("operator"),
            _place(text.address_of(c("Address")), "QLD").alias("address"), F.array().cast(CONNECTORS).alias("connectors"), _whole(plugs).alias("plug_count"), text.status_of(c("Status")).alias("status"), F.lit("unknown").alias("access"),
            _extra(host=text.clean_text(c("Host")), description=text.clean_text(c("Description")), nearest_station=text.clean_text(c("Nearest QESH charging station"))).alias("extra"),
            F.when(~geo.in_country(lat, lng), "missing or invalid coordinates").alias("_why"), _issues(("data_gap", plugs == "", F.lit("plug count column empty"))).alias("_issues"),
        )


class Osm(Source):
    id, name, licence, licence_url, share_alike = "osm", "OpenStreetMap", "ODbL 1.0", "https://opendatacommons.org/licenses/odbl/1-0/", True
    SCHEMA = "osm3s struct<timestamp_osm_base:string>, remark string, elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"

    def _raw(self, spark, path):
        return spark.read.schema(self.SCHEMA).json(path, multiLine=True)

    def validate(self, spark, path, ctx):
        r = self._raw(spark, path).select("remark", F.size("elements").alias("n"), quality.too_old(F.col("osm3s.timestamp_osm_base"), F.lit(ctx.as_of)).alias("old")).first()
        if r is None or r.n is None or r.n <= 0:
            return "no elements"
        return f"remark: {r.remark}" if r.remark else "data is more than 7 days old" if r.old else None

    def stage(self, spark, path, ctx):
        d = self._raw(spark, path).select(F.explode("elements").alias("e")).where(F.coalesce(F.col("e.type"), F.lit("")) != "count")
        d = d.withColumn("t", F.coalesce("e.tags", F.create_map().cast("map<string,string>")))
        tag = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at("t", F.lit(k)), F.lit("")) for k in ks])
        lat, lng = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
        sockets = F.map_entries(F.map_filter("t", lambda k, v: F.startswith(k, F.lit("socket:")) & ~k.rlike(":(output|voltage|current)$")))
        one = lambda s: _connectors(standard=text.connector_standard(F.substring(s["key"], 8, 200)), count=_whole(s["value"]), power=text.power_rating(F.try_element_at("t", F.concat(s["key"], F.lit(":output"))))["max_kw"])
        status = F.when((tag("construction") == "yes") | tag("construction:amenity").isNotNull(), "construction").when((tag("proposed") == "yes") | tag("proposed:amenity").isNotNull(), "planned").when((tag("disused") == "yes") | tag("disused:amenity").isNotNull(), "decommissioned").otherwise("operational")
        line = F.nullif(F.concat_ws(", ", F.nullif(F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")), F.lit("")), tag("addr:suburb", "addr:city"), tag("addr:state"), tag("addr:postcode")), F.lit(""))
        ref = F.concat_ws("/", "e.type", F.col("e.id").cast("string"))
        d = d.withColumn("_c", F.filter(F.transform(sockets, one), lambda c: c["standard"].isNotNull()))
        return d.select(
            ref.alias("source_record_id"), F.concat(F.lit("https://www.openstreetmap.org/"), ref).alias("source_url"), lat.alias("lat"), lng.alias("lng"),
            text.clean_text(tag("name", "short_name", "operator", "brand")).alias("name"), (tag("name", "short_name").isNull() & tag("operator", "brand").isNotNull()).alias("name_from_operator"),
            text.canonical_operator(tag("operator", "brand", "network")).alias("operator"), text.canonical_operator(tag("network", "brand")).alias("network"), F.when(line.isNotNull(), text.address_of(line)).alias("address"),
            F.col("_c").alias("connectors"), _whole(tag("capacity")).alias("plug_count"), F.nullif(F.array_max(F.transform("_c", lambda c: F.coalesce(c["power_kw"], F.lit(0.0)))), F.lit(0.0)).alias("max_power_kw"),
            status.alias("status"), text.access_of(tag("access")).alias("access"), text.fee_of(tag("fee")).alias("fee"), text.clean_text(tag("opening_hours")).alias("opening_hours"), text.clean_text(tag("website", "brand:website", "network:website")).alias("website"),
            quality.rejection(lat, lng).alias("_why"),
        )


def _plug_list(raw: Column, cut: str) -> Column:
    """Connectors of a list such as ``1 x CHAdeMO and 1 x CCS2/SAE``."""
    parts = F.filter(F.transform(F.split(text.clean_text(raw), cut), lambda p: F.trim(p)), lambda p: p != "")
    label = lambda p: F.get(F.split(F.regexp_extract(p, r"^(?:[0-9]+\s*[x×]\s*)?(.+)$", 1), "/"), F.lit(0))
    one = lambda p: _connectors(standard=text.connector_standard(label(p)), count=F.regexp_extract(p, r"^([0-9]+)\s*[x×]", 1).try_cast("int"), power=F.lit(None))
    return F.coalesce(F.filter(F.transform(parts, one), lambda c: c["standard"].isNotNull()), F.array().cast(CONNECTORS))


def _powered(connectors: Column, kw: Column) -> Column:
    return F.transform(connectors, lambda c: c.withField("power_kw", F.coalesce(F.nullif(c["power_kw"], F.lit(0.0)), kw)))


class Vic(Source):
    id, name, licence, licence_url = "vic", "Victoria destination charging", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"
    SCHEMA = "type string, features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:map<string,string>>>"

    def validate(self, spark, path, ctx):
        r = spark.read.schema(self.SCHEMA).json(path, multiLine=True).select("type", F.size("features").alias("n")).first()
        return None if r and r.type == "FeatureCollection" and r.n and r.n > 0 else "not a FeatureCollection with features"

    def stage(self, spark, path, ctx):
        d = spark.read.schema(self.SCHEMA).json(path, multiLine=True).select(F.posexplode("features").alias("i", "f"))
        p = lambda k: F.try_element_at("f.properties", F.lit(k))
        first = lambda *ks: F.coalesce(*[F.nullif(p(k), F.lit("")) for k in ks])
        lng, lat = F.coalesce(F.get("f.geometry.coordinates", F.lit(0)), p("longitude").try_cast("double")), F.coalesce(F.get("f.geometry.coordinates", F.lit(1)), p("latitude").try_cast("double"))
        due, done = text.clean_text(p("estimated_project_completion")), text.loose_date(p("estimated_project_completion"))
        status = F.when(due.isNull(), "operational").when(done.isNull(), "unknown").when(done > F.lit(ctx.as_of).cast("date"), "planned").otherwise("operational")
        d = d.withColumn("_p", text.power_rating(p("chargers"))).withColumn("_c", _plug_list(p("plug_type"), r"(?i),|\band\b|\+|;|\n"))
        return d.select(
            F.concat(F.lit("dcav:"), F.coalesce(F.nullif("f.id", F.lit("")), text.slug(F.coalesce(p("location"), F.col("i").cast("string")), 30))).alias("source_record_id"), lat.alias("lat"), lng.alias("lng"),
            text.clean_text(first("lead_organisation", "location")).alias("name"), text.canonical_operator(first("company", "lead_organisation")).alias("operator"), text.canonical_operator(p("company")).alias("network"),
            _place(text.address_of(p("address")), "VIC").alias("address"), _powered(F.col("_c"), F.col("_p.max_kw")).alias("connectors"), _whole(F.regexp_replace(p("number_of_chargers"), r"\.0$", "")).alias("plug_count"),
            F.col("_p.max_kw").alias("max_power_kw"), status.alias("status"), F.lit("unknown").alias("access"),
            _extra(**{k: text.clean_text(p(k)) for k in ("location", "region", "lead_organisation", "nearby_amenities_attractions", "dcav_site", "plug_type", "chargers", "plugshare_link")}).alias("extra"),
            F.when(~geo.in_country(lat, lng), "missing or invalid coordinates").alias("_why"),
            _issues(
                ("parse_failure", (F.size("_c") == 0) & text.clean_text(p("plug_type")).isNotNull(), F.concat(F.lit('cannot read the plugs "'), p("plug_type"), F.lit('"'))),
                ("parse_failure", due.isNotNull() & done.isNull(), F.concat(F.lit('cannot read the completion date "'), due, F.lit('"'))),
                ("status_flag", status == "planned", F.concat(F.lit("not built yet: due "), due)),
            ).alias("_issues"),
        )


class Ocm(Source):
    id, name, licence, licence_url = "ocm", "Open Charge Map", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"
    SCHEMA = (
        "ID bigint, AddressInfo struct<Latitude:double,Longitude:double,Title:string,AddressLine1:string,Town:string,StateOrProvince:string,Postcode:string>, "
        "Connections array<struct<ConnectionType:struct<Title:string>,ConnectionTypeID:bigint,Quantity:int,PowerKW:double>>, OperatorInfo struct<Title:string>, StatusType struct<Title:string,IsOperational:boolean>, "
        "UsageType struct<Title:string,IsPayAtLocation:boolean>, UsageCost string, NumberOfPoints int, DataProvider struct<Title:string,License:string,IsOpenDataLicensed:boolean>"
    )

    def stage(self, spark, path, ctx):
        d, c = spark.read.schema(self.SCHEMA).json(path, multiLine=True), F.col
        lat, lng = c("AddressInfo.Latitude"), c("AddressInfo.Longitude")
        one = lambda x: _connectors(standard=text.connector_standard(F.coalesce(F.nullif(x["ConnectionType"]["Title"], F.lit("")), x["ConnectionTypeID"].cast("string"))), count=x["Quantity"], power=x["PowerKW"])
        d = d.withColumn("_c", F.coalesce(F.filter(F.transform("Connections", one), lambda x: x["standard"].isNotNull()), F.array().cast(CONNECTORS)))
        line = F.nullif(F.concat_ws(", ", *[F.nullif(f"AddressInfo.{k}", F.lit("")) for k in ("AddressLine1", "Town", "StateOrProvince", "Postcode")]), F.lit(""))
        bad, closed = ~geo.in_country(lat, lng), F.coalesce(c("DataProvider.IsOpenDataLicensed") == F.lit(False), F.lit(False))
        op = text.canonical_operator(c("OperatorInfo.Title"))
        return d.select(
            F.concat(F.lit("ocm:"), c("ID").cast("string")).alias("source_record_id"), F.concat(F.lit("https://openchargemap.org/site/poi/details/"), c("ID").cast("string")).alias("source_url"), lat.alias("lat"), lng.alias("lng"),
            text.clean_text(c("AddressInfo.Title")).alias("name"), op.alias("operator"), op.alias("network"), F.when(line.isNotNull(), text.address_of(line)).alias("address"), c("_c").alias("connectors"), c("NumberOfPoints").alias("plug_count"),
            F.nullif(F.array_max(F.transform("_c", lambda x: F.coalesce(x["power_kw"], F.lit(0.0)))), F.lit(0.0)).alias("max_power_kw"),
            text.status_of(F.coalesce(F.nullif("StatusType.Title", F.lit("")), F.when(c("StatusType.IsOperational"), "operational"))).alias("status"), text.access_of(c("UsageType.Title")).alias("access"),
            F.when(F.coalesce(c("UsageCost"), F.lit("")) != "", True).otherwise(c("UsageType.IsPayAtLocation")).alias("fee"),
            _extra(data_provider=text.clean_text(c("DataProvider.Title")), data_provider_licence=text.clean_text(c("DataProvider.License")), usage_cost=text.clean_text(c("UsageCost"))).alias("extra"),
            F.when(bad, "missing or invalid coordinates").when(closed, F.concat(F.lit('skipped: provider "'), c("DataProvider.Title"), F.lit('" is not open-data licensed'))).alias("_why"),
            F.when(bad, "rejected").when(closed, "policy").alias("_kind"),
        )


# Fixed values.
ACT_DISTRICTS = ("Belconnen", "Gungahlin", "Inner North", "Inner South", "Molonglo Valley", "Tuggeranong", "Woden Valley")
TAS_BOX = (-43.9, -39.4, 143.5, 148.6)


class _Geocoded(Source):
    """Tables without coordinates: places come from the geocode cache."""

    requires_geocoding = True

    def _page(self, spark, path) -> DataFrame:
        return spark.read.text(path, wholetext=True).select(F.lit(1).alias("page_id"), F.col("value").alias("html"))

    def _fixed(self, d: DataFrame, ctx: Context, address: str) -> DataFrame:
        cache = ctx.geocodes if ctx.geocodes is not None else d.sparkSession.createDataFrame([], "key string, result struct<lat:double,lng:double,display_name:string,type:string>")
        return lookup.address_lookup(d, cache, address, "fix")


class Act(_Geocoded):
    id, name, licence, licence_url = "act", "ACT public chargers", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"

    def rows(self, page: DataFrame) -> DataFrame:
        """(label, cells) of the charger tables, with the district named by the last button before the table."""
        t = html.tables(page).where(F.array_join(F.get("rows", F.lit(0)), " | ").rlike("(?i)number of chargers"))
        b = html.labels(page, r"<button[^>]*>.{0,200}?</button>").where(F.lower("label").isin(*[x.lower() for x in ACT_DISTRICTS]))
        return html.labelled(t, b, 4000).select("label", F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("i", "cells"))

    @staticmethod
    def stated_totals(page: DataFrame) -> DataFrame:
        """chargers and bays that the page states of itself; null if it does not."""
        plain = text.html_text(F.regexp_replace("html", r"(?is)<script.*?</script>", ""))
        # The sentence in which the page counts its chargers.
        said = r"(?i)As of [A-Za-z]+ [0-9]{4},?\s*([0-9]+)\s+public EV chargers?\s+with\s+([0-9]+)\s+charging bays"
        return page.select(*[F.regexp_extract(plain, said, k).try_cast("long").alias(n) for k, n in ((1, "chargers"), (2, "bays"))])

    def validate(self, spark, path, ctx):
        page = self._page(spark, path)
        r = self.rows(page)
        n = r.select("label").distinct().count()
        if n != len(ACT_DISTRICTS):
            return f"expected {len(ACT_DISTRICTS)} district tables, found {n}"
        cell = lambda k: F.get("cells", F.lit(k)).try_cast("long")
        return quality.totals_match(r, {"chargers": cell(0), "bays": cell(1)}, self.stated_totals(page).first().asDict())

    def stage(self, spark, path, ctx):
        r = self.rows(self._page(spark, path))
        cell = lambda k: F.get("cells", F.lit(k))
        where = F.trim(F.regexp_replace(text.text_of(cell(4)), r"\s+", " "))
        # A house number, a range or a letter allowed, before a capitalised word.
        at = F.regexp_instr(where, F.lit(r"\b[0-9]+[a-zA-Z]?(?:\s*[-/]\s*[0-9]+)?\s+[A-Z]"))
        name = F.when(at > 1, F.nullif(F.regexp_replace(F.substring(where, F.lit(1), at - 1), r"[,\s]+$", ""), F.lit(""))).otherwise(F.nullif(F.trim(F.get(F.split(where, ","), F.lit(0))), F.lit("")))
        r = r.select("i", "cells", F.coalesce("label", F.lit("ACT")).alias("district"), name.alias("name"), F.nullif(F.when(at > 1, F.substring(where, at, F.length(where))).otherwise(where), F.lit("")).alias("addr"))
        d = self._fixed(r, ctx, "addr")
        kw = text.power_rating(cell(2))["max_kw"]
        plugs = _plug_list(F.regexp_replace(cell(3), "(?i)bring your own", ""), r"(?i),|\band\b|\bor\b|/|\+")
        d = d.withColumn("_c", _powered(F.array_distinct(plugs), kw)).withColumn("_kw", kw)
        why = (
            F.when(F.col("addr").isNull(), "row has no usable location").when(~F.col("was_asked"), F.concat(F.lit('address not in the geocode cache ("'), "addr", F.lit('")')))
            .when(F.col("fix").isNull(), F.concat(F.lit('geocoding found no coordinate for "'), "addr", F.lit('"'))).when(~geo.in_country(F.col("fix.lat"), F.col("fix.lng")), "geocoded coordinate outside the country")
        )
        return d.select(
            F.concat_ws(":", F.lit("act"), text.slug(F.col("district"), 18), text.slug(F.coalesce("name", "addr", F.col("i").cast("string")), 28)).alias("source_record_id"), F.col("fix.lat").alias("lat"), F.col("fix.lng").alias("lng"), text.clean_text(F.col("name")).alias("name"),
            _place(text.address_of(F.col("addr")), "ACT").alias("address"), F.col("_c").alias("connectors"), F.nullif(cell(1).try_cast("int"), F.lit(0)).alias("plug_count"), F.col("_kw").alias("max_power_kw"), F.lit("unknown").alias("status"), F.lit("public").alias("access"), F.lit(True).alias("geocoded"),
            _extra(district=F.col("district"), charger_count=cell(0), bay_count=cell(1), charger_type=cell(2), plug_type=cell(3), location=cell(4), geocode_match=F.col("fix.display_name")).alias("extra"), why.alias("_why"),
            _issues(
                ("parse_failure", F.col("_kw").isNull() & (text.text_of(cell(2)) != ""), F.concat(F.lit('cannot read the charger type "'), cell(2), F.lit('"'))),
                ("parse_failure", (F.size("_c") == 0) & (text.text_of(cell(3)) != ""), F.concat(F.lit('cannot read the plugs "'), cell(3), F.lit('"'))),
                ("status_flag", F.lit(True), F.lit("the page names what was funded, not what was built")),
            ).alias("_issues"),
        )


class Tas(_Geocoded):
    id, name, licence, licence_url = "tas", "Tasmania ChargeSmart grants", "CC BY 3.0 AU", "https://creativecommons.org/licenses/by/3.0/au/"

    def rows(self, page: DataFrame) -> DataFrame:
        """(label, at, cells, total): rows of the tables with a Location column; the total row is split off."""
        t = html.tables(page).withColumn("at", F.array_position(F.transform(F.get("rows", F.lit(0)), F.lower), "location") - 1).where("at >= 0")
        head = html.labels(page, r"<h[2-4][^>]*>.{0,200}?</h[2-4]>")
        t = html.labelled(t.drop("at"), head, 3000).withColumn("at", (F.array_position(F.transform(F.get("rows", F.lit(0)), F.lower), "location") - 1).cast("int"))
        d = t.select("label", "pos", "at", F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("i", "cells"))
        return d.withColumn("is_total", F.lower(F.trim(F.get("cells", F.lit(0)))) == "total")

    def validate(self, spark, path, ctx):
        r = self.rows(self._page(spark, path)).withColumn("amount", text.money(F.element_at("cells", -1)))
        got = r.groupBy("pos").agg(F.sum(F.when(~F.col("is_total"), F.coalesce("amount", F.lit(0.0)))).alias("s"), F.max(F.when(F.col("is_total"), F.col("amount"))).alias("t"), F.count_if(~F.col("is_total")).alias("n")).collect()
        if len(got) != 3:
            return f"expected 3 tables with a Location column, found {len(got)}"
        for g in got:
            if g.t is None or g.s != g.t:
                return f"parsed grants sum to {g.s} but the page states {g.t}"
        return None if sum(g.n for g in got) >= 40 else "fewer than 40 located grant rows"

    def stage(self, spark, path, ctx):
        r = self.rows(self._page(spark, path)).where(~F.col("is_total"))
        cell = lambda k: F.get("cells", k if isinstance(k, Column) else F.lit(k))
        place = text.html_text(cell(F.col("at")))
        # How a row counts its chargers.
        note = r"(?i)\((one|two|three|four|five|[0-9]+)\s+chargers?\)"
        said = F.lower(F.regexp_extract(text.text_of(cell(0)), note, 1))
        words = F.create_map(*[F.lit(x) for k, v in enumerate(("one", "two", "three", "four", "five"), 1) for x in (v, k)])
        org = text.clean_text(F.regexp_replace(cell(0), note, ""))
        r = r.select("*", F.coalesce(F.nullif(F.trim(F.regexp_extract(place, r"^(.*?)\s*\(([^)]+)\)\s*$", 1)), F.lit("")), place).alias("town"), F.nullif(F.regexp_extract(place, r"\(([^)]+)\)\s*$", 1), F.lit("")).alias("qualifier"), org.alias("org"))
        d, low = self._fixed(r, ctx, "town"), F.lower(text.text_of(F.col("label")))
        kind = F.when(F.contains(low, F.lit("fast charging")), "DCUnspecified").when(low.rlike("(destination|workplace) charging"), "ACUnspecified")
        outside = ~geo.is_valid(F.col("fix.lat"), F.col("fix.lng")) | ~geo.in_box(F.col("fix.lat"), F.col("fix.lng"), TAS_BOX)
        why = (
            F.when(F.col("town").isNull(), "row has no location").when(~F.col("was_asked"), F.concat(F.lit('town "'), "town", F.lit('" not in the geocode cache')))
            .when(F.col("fix").isNull(), F.concat(F.lit('geocoding found no coordinate for town "'), "town", F.lit('"'))).when(outside, F.concat(F.lit('geocode for "'), "town", F.lit('" resolved outside the state')))
        )
        address = F.struct(F.concat("town", F.lit(", TAS")).alias("full"), F.lit(None).cast("string").alias("street"), F.col("town").alias("suburb"), F.lit("TAS").alias("state"), F.lit(None).cast("string").alias("postcode"))
        return d.select(
            F.concat_ws(":", F.lit("tas"), text.slug(F.coalesce("label", F.lit("round")), 20), text.slug(F.concat_ws("-", cell(0), F.coalesce("town", F.col("i").cast("string"))), 40)).alias("source_record_id"), F.col("fix.lat").alias("lat"), F.col("fix.lng").alias("lng"),
            F.concat_ws(" — ", "org", "town").alias("name"), text.canonical_operator(F.col("org")).alias("operator"), address.alias("address"),
            F.when(kind.isNotNull(), F.array(_connectors(standard=kind, count=F.lit(None), power=F.lit(None)))).otherwise(F.array().cast(CONNECTORS)).alias("connectors"), F.coalesce(F.try_element_at(words, said), said.try_cast("int")).alias("plug_count"),
            F.lit("unknown").alias("status"), F.lit("unknown").alias("access"), F.lit(True).alias("geocoded"), F.lit(text.BY_LOCALITY).alias("position_precision"),
            _extra(round=F.col("label"), amount=text.money(F.element_at("cells", -1)), town=F.col("town"), qualifier=F.col("qualifier"), region=text.clean_text(cell(F.col("at") + 1)), organisation=text.clean_text(cell(0)), geocode_match=F.col("fix.display_name")).alias("extra"), why.alias("_why"),
            _issues(("status_flag", F.lit(True), F.lit("the page names what was funded, not what was built")), ("data_gap", F.lit(True), F.concat(F.lit('town-level position only ("'), "town", F.lit('")')))).alias("_issues"),
        )


ALL: dict[str, Source] = {s.id: s for s in (Osm(), Nsw(), Vic(), Qld(), Act(), Tas(), Ocm())}
#: The open map needs a key, so it runs only when asked for.
DEFAULT_IDS = ("osm", "nsw", "vic", "qld", "act", "tas")


def select(ids: list[str] | None = None) -> list[Source]:
    """Adapters by id; none named gives the defaults, an unknown id raises."""
    names = list(ids or DEFAULT_IDS)
    unknown = [i for i in names if i not in ALL]
    if unknown:
        raise ValueError(f"unknown source: {', '.join(unknown)}; one of {', '.join(ALL)}")
    return [ALL[i] for i in names]


def catalogue(spark: SparkSession) -> DataFrame:
    """One row for each adapter, the one that is off by default included."""
    rows = [(s.id, s.name, s.licence, s.licence_url, s.attribution_required, s.share_alike, s.requires_geocoding, s.id in DEFAULT_IDS) for s in ALL.values()]
    return spark.createDataFrame(rows, "source_id string, name string, licence string, licence_url string, attribution_required boolean, share_alike boolean, requires_geocoding boolean, on_by_default boolean")


def attribution(spark: SparkSession, ids: list[str]) -> DataFrame:
    """(source_id, text, licence, licence_url, share_alike) of the sources that ask for it, and of geocoding if it was used."""
    c = catalogue(spark).where(F.col("source_id").isin(*ids))
    own = c.where("attribution_required").select("source_id", F.concat(F.lit("Data: "), "name").alias("text"), "licence", "licence_url", "share_alike")
    geo_ = c.where("requires_geocoding").limit(1).select(F.lit("geocoding").alias("source_id"), F.lit("Geocoding: OpenStreetMap contributors").alias("text"), F.lit("ODbL 1.0").alias("licence"), F.lit("https://opendatacommons.org/licenses/odbl/1-0/").alias("licence_url"), F.lit(True).alias("share_alike"))
    return own.unionByName(geo_)

"""The faceted query engine over sites."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo, text

DEFAULT_STATUSES = ("operational", "unknown")
MAX_LIMIT = 10_000
SORTS = ("distance", "relevance", "power", "confidence", "name")
#: field -> weight of a match.
TEXT_FIELDS = (("name", 3.0), ("display_name", 3.0), ("operator", 2.0), ("network", 1.0))


def _listed(v) -> tuple | None:
    if v is None or v == "" or v == []:
        return None
    return tuple(v) if isinstance(v, (list, tuple, set)) else (v,)


def _number(v, name: str) -> float | None:
    if v is None or v == "":
        return None
    x = float(v)
    if x != x:
        raise ValueError(f"{name} is not a number")
    return x


@dataclass(frozen=True)
class SiteQuery:
    """A validated query; ``from_raw`` takes loose values such as request parameters."""

    statuses: tuple = DEFAULT_STATUSES
    precisions: tuple = (text.SURVEYED, text.BY_ADDRESS)
    states: tuple | None = None
    operators: tuple | None = None
    connectors: tuple | None = None
    speed_bands: tuple | None = None
    min_power_kw: float | None = None
    max_power_kw: float | None = None
    min_sources: float | None = None
    min_confidence: float | None = None
    box: tuple | None = None
    lat: float | None = None
    lng: float | None = None
    radius_km: float | None = None
    text: str | None = None
    sort: str | None = None
    limit: int | None = 100
    offset: int = 0
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_raw(cls, **raw) -> SiteQuery:
        statuses = _listed(raw.get("statuses")) or DEFAULT_STATUSES
        if raw.get("include_planned") and "planned" not in statuses:
            statuses = (*statuses, "planned")
        precisions = _listed(raw.get("precisions")) or (text.SURVEYED, text.BY_ADDRESS)
        if raw.get("include_approximate"):
            precisions = (text.SURVEYED, text.BY_ADDRESS, text.BY_LOCALITY)
        states = _listed(raw.get("states"))
        limit = raw.get("limit", 100)
        if limit is not None:
            limit = _number(limit, "limit")
            limit = 100 if limit is None else limit
            if limit < 0 or limit == float("inf"):
                raise ValueError("limit must be a non-negative number")
            limit = int(min(limit, MAX_LIMIT))
        lat, lng, radius = (_number(raw.get(k), k) for k in ("lat", "lng", "radius_km"))
        if radius is not None and (lat is None or lng is None):
            raise ValueError("radius_km requires both lat and lng")
        sort = raw.get("sort") or None
        if sort is not None and sort not in SORTS:
            raise ValueError(f"unknown sort {sort!r}; one of {', '.join(SORTS)}")
        box = raw.get("box")
        return cls(
            statuses=statuses, precisions=precisions, states=tuple(str(s).upper() for s in states) if states else None,
            operators=_listed(raw.get("operators")), connectors=_listed(raw.get("connectors")), speed_bands=_listed(raw.get("speed_bands")),
            min_power_kw=_number(raw.get("min_power_kw"), "min_power_kw"), max_power_kw=_number(raw.get("max_power_kw"), "max_power_kw"),
            min_sources=_number(raw.get("min_sources"), "min_sources"), min_confidence=_number(raw.get("min_confidence"), "min_confidence"),
            box=tuple(map(float, box)) if box else None, lat=lat, lng=lng, radius_km=radius, text=(raw.get("text") or "").strip() or None,
            sort=sort, limit=limit, offset=int(raw.get("offset") or 0),
        )

    @property
    def order(self) -> str:
        """The sort that holds: the one asked for, else by distance, relevance or power."""
        if self.sort:
            return self.sort
        if self.lat is not None and self.lng is not None:
            return "distance"
        return "relevance" if self.text else "power"


def from_params(params: dict[str, str | list[str]]) -> SiteQuery:
    """A query from request parameters: repeated and comma-separated values are equal, bbox is minLng,minLat,maxLng,maxLat."""
    names = {
        "q": "text", "text": "text", "lat": "lat", "lng": "lng", "lon": "lng", "radius": "radius_km", "radius_km": "radius_km", "radiusKm": "radius_km",
        "state": "states", "states": "states", "operator": "operators", "operators": "operators", "connector": "connectors", "connectors": "connectors",
        "speed": "speed_bands", "speed_bands": "speed_bands", "speedBands": "speed_bands", "min_kw": "min_power_kw", "minPowerKw": "min_power_kw", "max_kw": "max_power_kw",
        "maxPowerKw": "max_power_kw", "status": "statuses", "statuses": "statuses", "min_sources": "min_sources", "minSources": "min_sources", "min_confidence": "min_confidence",
        "minConfidence": "min_confidence", "sort": "sort", "limit": "limit", "offset": "offset", "include_planned": "include_planned", "includePlanned": "include_planned",
        "include_approximate": "include_approximate", "includeApproximate": "include_approximate",
    }
    many = {"states", "operators", "connectors", "speed_bands", "statuses"}
    raw: dict = {}
    for k, v in params.items():
        vals = [x.strip() for y in (v if isinstance(v, list) else [v]) for x in str(y).split(",")]
        if k == "bbox":
            if len(vals) != 4:
                raise ValueError("bbox needs minLng,minLat,maxLng,maxLat")
            a, b, c, d = map(float, vals)
            raw["box"] = (b, d, a, c)
        elif (name := names.get(k)) in many:
            raw[name] = [*raw.get(name, []), *[x for x in vals if x]]
        elif name and name.startswith("include_"):
            raw[name] = str(v).lower() in ("", "1", "true", "yes")
        elif name:
            raw[name] = v[-1] if isinstance(v, list) else v
    return SiteQuery.from_raw(**raw)


#: Rows that a list beside a map shows, and the zoom from which a map asks for its view alone.
LIST_ROWS, VIEW_ZOOM = 120, 7
#: Key of a link -> key of the state it stands for.
LINK_KEYS = {"site": "site", "q": "text", "state": "state", "connector": "connector", "operator": "operator", "minKw": "min_power_kw", "corroborated": "corroborated", "planned": "include_planned", "approx": "include_approximate"}
FLAGS = ("corroborated", "include_planned", "include_approximate")


def from_state(state: dict, zoom: float | None = None, view: tuple | None = None) -> SiteQuery:
    """The query of a map's controls, without a limit; a close view without text bounds it by its box."""
    only = lambda k: [state[k]] if state.get(k) else None
    close = view is not None and zoom is not None and zoom >= VIEW_ZOOM and not state.get("text")
    centre = state.get("centre") or (None, None)
    return SiteQuery.from_raw(
        text=state.get("text"), min_power_kw=state.get("min_power_kw"), connectors=only("connector"), states=only("state"), operators=only("operator"), min_sources=2 if state.get("corroborated") else None,
        include_planned=state.get("include_planned"), include_approximate=state.get("include_approximate"), lat=centre[0], lng=centre[1], box=view if close else None, limit=None,
    )


def list_cut(m: DataFrame, q: SiteQuery, id_col: str = "id") -> DataFrame:
    """The rows that the list beside the map shows."""
    return m.orderBy(*ordering(m, q, id_col)).limit(LIST_ROWS)


def to_link(state: dict) -> str:
    """The part of a link after #, from the values that are set."""
    told = {k: "1" if v in FLAGS and state.get(v) else state.get(v) for k, v in LINK_KEYS.items()}
    number = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return "&".join(f"{k}={quote(str(number(v)), safe="!~*()'")}" for k, v in told.items() if v not in (None, "", False))


def from_link(link: str) -> dict:
    """The state of a link: every key, with what it does not name cleared."""
    pairs = dict(p.split("=", 1) for p in link.removeprefix("#").split("&") if "=" in p)
    told = {v: unquote(pairs[k]) if pairs.get(k) else None for k, v in LINK_KEYS.items()}
    return told | {k: bool(told[k]) for k in FLAGS} | {"min_power_kw": float(told["min_power_kw"]) if told["min_power_kw"] else None}


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def predicates(df: DataFrame, q: SiteQuery) -> list[Column]:
    """The query's filters, cheap and pushable ones first; all must hold."""
    out = [F.col("status").isin(*q.statuses)] if "status" in df.columns else []
    if q.box:
        out.append(geo.in_box(F.col("lat"), F.col("lng"), q.box))
    if q.radius_km is not None:
        out.append(geo.in_box(F.col("lat"), F.col("lng"), geo.box_around(q.lat, q.lng, q.radius_km * 1000)))
    precision = text.position_precision(_col(df, "position_precision"), _col(df, "geocoded", "boolean"))
    out.append(precision.isin(*q.precisions))
    if q.states:
        out.append(F.upper(F.coalesce(_col(df, "state"), F.lit(""))).isin(*q.states))
    if q.operators:
        out.append(F.col("operator").isin(*q.operators))
    power = F.coalesce(_col(df, "max_power_kw", "double"), F.lit(0.0))
    if q.min_power_kw is not None:
        out.append(power >= q.min_power_kw)
    if q.max_power_kw is not None:
        out.append(power <= q.max_power_kw)
    if q.speed_bands:
        out.append(F.col("speed_band").isin(*q.speed_bands))
    if q.connectors:
        out.append(F.arrays_overlap(F.transform("connectors", lambda c: c["standard"]), F.array(*[F.lit(c) for c in q.connectors])))
    if q.min_sources:
        out.append(F.col("source_count") >= q.min_sources)
    if q.min_confidence:
        out.append(F.col("confidence") >= q.min_confidence)
    return out


def matched(df: DataFrame, q: SiteQuery) -> DataFrame:
    """All rows that the query selects, with _distance and _score where they apply."""
    out = df.where(reduce(lambda a, b: a & b, predicates(df, q)))
    if q.lat is not None and q.lng is not None:
        out = out.withColumn("_distance", geo.haversine_m(F.col("lat"), F.col("lng"), q.lat, q.lng))
        if q.radius_km is not None:
            out = out.where(F.col("_distance") <= q.radius_km * 1000)
    if q.text:
        parts = [F.col("address")[k] for k in ("suburb", "street", "postcode")] if "address" in df.columns else []
        fields = [(F.col(c), w) for c, w in TEXT_FIELDS if c in df.columns]
        out = out.withColumn("_score", text.text_score(q.text, fields, parts, _col(df, "name"))).where(F.col("_score") > 0)
    return out


def ordering(df: DataFrame, q: SiteQuery, id_col: str = "id") -> list[Column]:
    """A total order: the query's sort, then the id."""
    distance = [F.col("_distance").asc_nulls_last()] if "_distance" in df.columns else []
    keys = {
        "distance": distance,
        "relevance": ([F.col("_score").desc()] if "_score" in df.columns else []) + distance,
        "power": [F.coalesce(_col(df, "max_power_kw", "double"), F.lit(0.0)).desc()],
        "confidence": [_col(df, "confidence", "double").desc()],
        "name": [F.expr("coalesce(nullif(name, ''), '~') COLLATE UNICODE").asc()] if "name" in df.columns else [],
    }[q.order]
    return [*keys, F.col(id_col).asc()]


def page(m: DataFrame, q: SiteQuery, id_col: str = "id") -> DataFrame:
    """The asked page with rounded distance and relevance."""
    out = m.orderBy(*ordering(m, q, id_col))
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    if "_distance" in m.columns:
        out = out.withColumn("distance_m", F.round("_distance").cast("long")).withColumn("distance_km", F.round(F.col("_distance") / 1000, 2)).drop("_distance")
    if "_score" in m.columns:
        out = out.withColumn("relevance", F.round("_score", 3)).drop("_score")
    return out


def facets(m: DataFrame) -> DataFrame:
    """(facet, value, n) over all matched rows, one aggregation over the unpivoted keys."""
    pairs = [
        ("state", F.coalesce(_col(m, "state"), F.lit("unknown"))), ("operator", F.coalesce(_col(m, "operator"), F.lit("unknown"))), ("speed_band", _col(m, "speed_band")),
        ("status", _col(m, "status")), ("source_count", _col(m, "source_count").cast("string")),
        ("position_precision", text.position_precision(_col(m, "position_precision"), _col(m, "geocoded", "boolean"))),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in pairs])
    if "connectors" in m.columns:
        rows = F.concat(rows, F.coalesce(F.transform("connectors", lambda c: F.struct(F.lit("connector").alias("facet"), c["standard"].alias("value"))), F.array().cast("array<struct<facet:string,value:string>>")))
    return m.select(F.explode(rows).alias("f")).where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Result:
    """What a query gives; every part is a DataFrame over the same matched rows."""

    matched: DataFrame
    page: DataFrame
    facets: DataFrame


def search(sites: DataFrame, q: SiteQuery, id_col: str = "id") -> Result:
    m = matched(sites, q)
    return Result(m, page(m, q, id_col), facets(m))


def by_id(sites: DataFrame, site_id, id_col: str = "id") -> DataFrame:
    return sites.where(F.col(id_col) == F.lit(site_id)).limit(1)


def nearest(sites: DataFrame, lat: float, lng: float, n: int = 5, statuses=DEFAULT_STATUSES, id_col: str = "id") -> DataFrame:
    """The n nearest mappable sites, a bounded top-k; ValueError without a centre or for n outside 1..100."""
    if lat is None or lng is None:
        raise ValueError("nearest needs lat and lng")
    if not 1 <= n <= 100:
        raise ValueError("n must be in 1..100")
    precision = text.position_precision(_col(sites, "position_precision"), _col(sites, "geocoded", "boolean"))
    d = sites.where(F.col("status").isin(*statuses) & text.is_mappable(precision))
    d = d.withColumn("_distance", geo.haversine_m(F.col("lat"), F.col("lng"), lat, lng)).orderBy("_distance", id_col).limit(n)
    return d.withColumn("distance_m", F.round("_distance").cast("long")).drop("_distance")

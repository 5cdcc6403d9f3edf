"""Geography on double columns; everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0
COUNTRY_BOX = (-44.0, -9.0, 112.0, 154.5)
MERCATOR_M_PER_PIXEL = 156_543.03392


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def rough_m(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular metres, for short distances; the shorter way round, also across the date line."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    east = lng2 - lng1
    x = (east - 360 * F.rint(east / 360)) * F.cos(F.radians((lat1 + lat2) / 2)) * METRES_PER_DEGREE
    y = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(x * x + y * y)


def is_valid(lat: Column, lng: Column, any_turn: bool = False) -> Column:
    """Both finite, in range and not the null island; never null. With ``any_turn`` longitudes may run on past 180 degrees."""
    ok = lat.between(-90, 90) & (F.abs(lng) < float("inf") if any_turn else lng.between(-180, 180)) & ~F.isnan(lat) & ~F.isnan(lng) & ~((lat == 0) & (lng == 0))
    return F.coalesce(ok, F.lit(False))


def in_country(lat: Column, lng: Column) -> Column:
    a, b, c, d = COUNTRY_BOX
    return is_valid(lat, lng) & lat.between(a, b) & lng.between(c, d)


def state_of(lat: Column, lng: Column) -> Column:
    """State by ordered rectangles; null outside the country."""
    return (
        F.when(~in_country(lat, lng), F.lit(None).cast("string"))
        .when(lat.between(-35.95, -35.1) & lng.between(148.75, 149.4), "ACT")
        .when(lng < 129, "WA")
        .when(lat < -39.5, "TAS")
        .when((lng < 141) & (lat > -26), "NT")
        .when(lng < 141, "SA")
        .when(lat > -29, "QLD")
        .when((lat < -34) & (lng < 150), "VIC")
        .otherwise("NSW")
    )


def lat_step(cell_m: float) -> float:
    return cell_m / METRES_PER_DEGREE


def lng_step(lat: Column, cell_m: float) -> Column:
    """Degrees of longitude of one cell at the row's own latitude, floored near the poles."""
    return F.lit(float(cell_m)) / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))


def cell(lat: Column, lng: Column, cell_m: float) -> tuple[Column, Column]:
    """(row, column) of the grid cell as bigints."""
    return F.floor(lat / F.lit(lat_step(cell_m))).cast("long"), F.floor(lng / lng_step(lat, cell_m)).cast("long")


def box_around(lat: float, lng: float, radius_m: float) -> tuple[float, float, float, float]:
    """(min lat, max lat, min lng, max lng) around a point."""
    dlat = radius_m / METRES_PER_DEGREE
    dlng = radius_m / (METRES_PER_DEGREE * max(0.2, math.cos(math.radians(lat))))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (min lat, max lat, min lng, max lng); a box all the way round holds every longitude, however it is counted."""
    round_trip = box[3] - box[2] >= 360
    return lat.between(box[0], box[1]) & (F.coalesce(F.abs(lng) < float("inf"), F.lit(False)) if round_trip else lng.between(box[2], box[3]))


def metres_per_pixel(lat: float, zoom: int) -> float:
    """Ground length of a map's pixel at a latitude."""
    return MERCATOR_M_PER_PIXEL * math.cos(math.radians(lat)) / 2**zoom


def round_coord(x: Column, places: int = 6) -> Column:
    return F.round(x, places)

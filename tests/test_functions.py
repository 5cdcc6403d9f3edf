"""Literal cases of the column functions."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, out", [
    ("BP Australia", "BP Pulse"), ("BP", "BP Pulse"), ("Tesla Motors", "Tesla"), ("tesla supercharger site 12", "Tesla"), ("n/a", "Non-networked"), ("", None), (None, None),
    ("Some New Network", "Some New Network"), ("  Odd   spacing ", "Odd spacing"), ("Evie Networks Pty Ltd", "Evie Networks"),
])
def test_operator(spark, raw, out):
    assert value(spark, text.canonical_operator(F.lit(raw).cast("string"))) == out


@pytest.mark.parametrize("raw, out", [
    ("CCS (Type 2)", "CCS2"), ("type2_combo", "CCS2"), ("CHAdeMO", "CHAdeMO"), ("Type 2 (Socket Only)", "Type2"), ("type1", "Type1"), ("J1772", "Type1"), ("Tesla Supercharger", "TeslaProprietary"), ("AC", "ACUnspecified"), ("DC", "DCUnspecified"), ("???", None), (None, None),
])
def test_connector(spark, raw, out):
    assert value(spark, text.connector_standard(F.lit(raw).cast("string"))) == out


@pytest.mark.parametrize("raw, groups, top", [
    ("22 kW", [(1, 22.0)], 22.0), ("2x350kW & 2x175kW", [(2, 350.0), (2, 175.0)], 350.0), ("AC", [], None), ("", [], None), (None, [], None), ("0.5 MW", [(1, 500.0)], 500.0), ("5000 kW", [], None), ("99x50kW", [(64, 50.0)], 50.0),
])
def test_power(spark, raw, groups, top):
    p = value(spark, text.power_rating(F.lit(raw).cast("string")))
    assert [(g["count"], g.kw) for g in p.groups] == groups and p.max_kw == top


@pytest.mark.parametrize("kw, band", [(None, "unknown"), (0.0, "unknown"), (3.0, "trickle"), (7.0, "slow"), (25.0, "medium"), (50.0, "fast"), (150.0, "rapid"), (250.0, "ultra"), (float("nan"), "unknown")])
def test_band(spark, kw, band):
    assert value(spark, text.speed_band(F.lit(kw).cast("double"))) == band


@pytest.mark.parametrize("raw, out", [("Upcoming", "planned"), ("under construction", "construction"), ("Removed", "decommissioned"), ("not operational", "operational"), ("", "unknown"), ("?", "unknown")])
def test_status(spark, raw, out):
    assert value(spark, text.status_of(F.lit(raw))) == out


@pytest.mark.parametrize("raw, out", [
    ("38 Abbott Rd, Seven Hills NSW 2147", ("38 Abbott Rd", "Seven Hills", "NSW", "2147")), (", Muswellbrook, 2333", (None, "Muswellbrook", None, "2333")), ("Civic Square", (None, "Civic Square", None, None)),
    ("Unit 2 Main St", ("Unit 2 Main St", None, None, None)), ("", (None, None, None, None)), (None, (None, None, None, None)), ("2000 Long Rd, Perth WA 6000", ("2000 Long Rd", "Perth", "WA", "6000")),
])
def test_address(spark, raw, out):
    a = value(spark, text.address_of(F.lit(raw).cast("string")))
    assert (a.street, a.suburb, a.state, a.postcode) == out


@pytest.mark.parametrize("raw, out", [
    ("31/07/2023", (2023, 7, 31)), ("30 November 2023", (2023, 11, 30)), ("December 2026", (2026, 12, 1)), ("2024-05-06", (2024, 5, 6)), ("2024-05", (2024, 5, 1)), ("31/02/2023", (2023, 3, 3)), ("1/13/2023", None), ("soon", None), (None, None),
])
def test_date(spark, raw, out):
    assert value(spark, text.loose_date(F.lit(raw).cast("string"))) == (datetime.date(*out) if out else None)


@pytest.mark.parametrize("raw, n, out", [("Evie Networks", 14, "evie-networks"), ("Café Olé!", 40, "cafe-ole"), ("--A--B--", 40, "a-b"), ("abcdefghij klm", 11, "abcdefghij-"), (None, 5, ""), ("élan", 9, "e-lan")])
def test_slug(spark, raw, n, out):
    assert value(spark, text.slug(F.lit(raw).cast("string"), n)) == out


def test_words(spark):
    assert value(spark, text.clean_text(F.lit(" a\x00\n b  "))) == "a b"
    assert value(spark, text.clean_text(F.lit("  "))) is None
    assert value(spark, text.token_similarity(F.lit("Ampol Foodary Seven Hills"), F.lit("Ampol Seven Hills charging station"))) == 0.75
    assert value(spark, text.token_similarity(F.lit("the station"), F.lit("x"))) == 0
    assert value(spark, text.fnv1a(F.lit("abc"))) == 0x1A47E90B
    assert value(spark, text.html_text(F.lit("<b>Tom &amp; Jerry&#39;s&nbsp;</b><br>x"))) == "Tom & Jerry's x"
    assert value(spark, text.redact_url(F.lit("https://x/?a=1&KEY=abc&token=z"))) == "https://x/?a=1&KEY=REDACTED&token=REDACTED"
    assert value(spark, text.money(F.lit("$50,000"))) == 50000
    assert value(spark, text.query_variants(F.lit("Sentinel Apartments 39 Benjamin Way, Belconnen"), F.lit("ACT"))) == ["Sentinel Apartments 39 Benjamin Way, Belconnen, ACT", "39 Benjamin Way, Belconnen, ACT", "Belconnen, ACT"]
    assert value(spark, text.fee_of(F.lit("maybe"))) is None and value(spark, text.fee_of(F.lit("Free"))) is False
    assert value(spark, text.access_of(F.lit("Customers only"))) == "restricted"


@pytest.mark.parametrize("query, expect", [("red", True), ("red widget", True), ("red red", False), ("blue", False), ("widgetx", False)])
def test_text_score(spark, query, expect):
    s = text.text_score(query, [(F.lit("Red Widget Place"), 3.0)], [F.lit("Hills")], F.lit("Red Widget Place"))
    assert (value(spark, s) > 0.4) == expect


def test_geo(spark):
    d = value(spark, geo.haversine_m(F.lit(-33.8688), F.lit(151.2093), -37.8136, 144.9631))
    assert math.isclose(d, 713_430, rel_tol=1e-3)
    for lat, lng, ok in ((0, 0, False), (91, 0, False), (float("nan"), 1, False), (None, 1, False), (-33.0, 151.0, True)):
        assert value(spark, geo.is_valid(F.lit(lat).cast("double"), F.lit(lng).cast("double"))) is ok
    for lat, lng, state in ((-35.3, 149.1, "ACT"), (-31.9, 115.9, "WA"), (-42.9, 147.3, "TAS"), (-12.5, 130.8, "NT"), (-34.9, 138.6, "SA"), (-27.5, 153.0, "QLD"), (-37.8, 145.0, "VIC"), (-33.9, 151.2, "NSW"), (51.5, 0.1, None)):
        assert value(spark, geo.state_of(F.lit(float(lat)), F.lit(float(lng)))) == state

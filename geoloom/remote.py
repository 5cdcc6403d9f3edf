"""What each source asks its publisher for, and fetching it with follow-up requests."""

from __future__ import annotations

import json
import os
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

from geoloom import fetch

# Where the publishers serve their data.
OSM_MIRRORS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter")
OSM_QUERY = (
    '[out:json][timeout:280];\narea["ISO3166-1"="AU"][admin_level=2]->.a;\n(\n  node["amenity"="charging_station"](area.a);\n'
    '  way["amenity"="charging_station"](area.a);\n);\nout center tags;'
)
NSW_PACKAGE = "https://opendata.transport.nsw.gov.au/data/api/3/action/package_show?id=be1c4de4-4517-4bd0-8a09-2965ddfc7179"
NSW_LAST_KNOWN = "https://opendata.transport.nsw.gov.au/data/dataset/be1c4de4-4517-4bd0-8a09-2965ddfc7179/resource/7bbb6461-e52d-4fe7-ace4-a15c30198de0/download/ev_20251216.csv"
VIC_SERVICE, VIC_LAYER = "https://opendata.maps.vic.gov.au/geoserver/wfs", "open-data-platform:dcav_site"
QLD_FILE = "https://www.tmr.qld.gov.au/-/media/aboutus/corpinfo/Open%20data/findachargingev/csl_ev.csv"
OCM_SERVICE = "https://api.openchargemap.io/v3/poi"
#: The publisher refuses agents that are no browser.
BROWSER = {"user-agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124 Safari/537.36", "accept": "text/csv,*/*"}


@dataclass(frozen=True)
class Request:
    """One file to get: mirrors in order, what to send, and what to ask for next once it is there."""

    key: str
    urls: tuple[str, ...]
    body: bytes | None = None
    headers: dict = field(default_factory=dict)
    secrets: tuple[str, ...] = ()
    check: Callable[[bytes], str | None] | None = None
    then: Callable[[bytes], list[Request]] | None = None


@dataclass(frozen=True)
class Got:
    """The data files of one source in order; ``skipped`` if it had nothing to ask for."""

    files: list[fetch.Fetched]
    followed: list[fetch.Fetched]
    skipped: bool = False


def _told(data: bytes):
    try:
        return json.loads(data)
    except ValueError:
        return None


def check_osm(data: bytes) -> str | None:
    d = _told(data)
    if not isinstance(d, dict) or not isinstance(d.get("elements"), list):
        return "no elements array"
    if d.get("remark"):
        return f"remark: {d['remark']}"
    return None if d["elements"] else "no elements"


def check_vic(data: bytes) -> str | None:
    d = _told(data)
    return None if isinstance(d, dict) and d.get("type") == "FeatureCollection" and d.get("features") else "not a FeatureCollection with features"


def check_qld(data: bytes) -> str | None:
    t = data.decode("utf-8", "replace")
    if t.lstrip().startswith("<") or "request has failed" in t.lower():
        return "an HTML error page instead of CSV"
    return None if "latitude" in t.lower() else "no Latitude column"


def check_ocm(data: bytes) -> str | None:
    return None if isinstance(_told(data), list) else "not an array of places"


def newest_csv(data: bytes) -> str:
    """url of the newest CSV resource that is kept up to date, else the last one known."""
    told = _told(data)
    resources = ((told.get("result") or {}).get("resources") or []) if isinstance(told, dict) else []
    kept = [r for r in resources if str(r.get("format")).upper() == "CSV" and "not updated" not in (r.get("name") or "").lower()]
    newest = max(kept, key=lambda r: r.get("last_modified") or r.get("created") or "", default=None)
    return newest["url"] if newest else NSW_LAST_KNOWN


def vic_url(layer: str = VIC_LAYER) -> str:
    return f"{VIC_SERVICE}?" + urllib.parse.urlencode({"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": layer, "outputFormat": "application/json"})


def requests(source_id: str, key: str | None = None, page: str | None = None) -> list[Request]:
    """What ``source_id`` asks for first; nothing without the key that a source needs.

    ``page`` is the address of the pages of the sources without a data file.
    """
    if source_id == "osm":
        return [Request("osm-au-chargers.json", OSM_MIRRORS, urllib.parse.urlencode({"data": OSM_QUERY}).encode(), {"content-type": "application/x-www-form-urlencoded"}, check=check_osm)]
    if source_id == "nsw":
        return [Request("nsw-package.json", (NSW_PACKAGE,), then=lambda d: [Request("nsw-ev.csv", (newest_csv(d),))])]
    if source_id == "vic":
        return [Request("vic-dcav.json", (vic_url(),), check=check_vic)]
    if source_id == "qld":
        return [Request("qld-ev.csv", (QLD_FILE,), headers=BROWSER, check=check_qld)]
    if source_id == "ocm":
        if not key:
            return []
        asked = {"output": "json", "countrycode": "AU", "opendata": "true", "maxresults": "10000", "compact": "false", "verbose": "false", "key": key}
        return [Request("ocm-au.json", (f"{OCM_SERVICE}?{urllib.parse.urlencode(asked)}",), secrets=(key,), check=check_ocm)]
    if source_id in ("act", "tas"):
        return [Request(f"{source_id}.html", (page,))] if page else []
    raise ValueError(f"unknown source: {source_id}")


def get_source(first: list[Request], folder: str, offline: bool = False, get: Callable[[str, bytes | None, dict], bytes] = fetch.http_send) -> Got:
    """Retrieve every request and those that follow from it, breadth first."""
    queue, files, followed = list(first), [], []
    while queue:
        r = queue.pop(0)
        got = fetch.retrieve(r.key, list(r.urls), folder, r.check, offline, lambda url, r=r: get(url, r.body, r.headers), r.secrets)
        if r.then is None:
            files.append(got)
            continue
        followed.append(got)
        with open(got.path, "rb") as f:
            queue += r.then(f.read())
    return Got(files, followed, not first)


def get_all(ids: list[str], folder: str, offline: bool = False, keys: dict[str, str] | None = None, pages: dict[str, str] | None = None, get=fetch.http_send) -> tuple[dict[str, str], dict[str, str]]:
    """(path of the data file, what went wrong or ``skipped``) by source; one bad source does not end the run."""
    paths, failed = {}, {}
    for i in ids:
        try:
            got = get_source(requests(i, (keys or {}).get(i), (pages or {}).get(i)), folder, offline, get)
        except (OSError, ValueError) as e:
            failed[i] = str(e)
            continue
        if got.skipped:
            failed[i] = "skipped"
        else:
            paths[i] = "file://" + os.path.abspath(got.files[-1].path)
    return paths, failed

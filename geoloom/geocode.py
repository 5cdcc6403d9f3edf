"""The geocode cache as a JSON file, lookups that fill it, and the cache as a DataFrame."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from geoloom import fetch

# The lookup service and the pause that it asks for.
SERVICE, PAUSE_S = "https://nominatim.openstreetmap.org/search", 1.1
AGENT = "geoloom open-data integration (addresses looked up once and kept)"
SCHEMA = "key string, result struct<lat:double,lng:double,display_name:string,type:string>"


@dataclass
class Stats:
    """Counts of one run of lookups, and of the cache after it."""

    requested: int = 0
    from_cache: int = 0
    fetched: int = 0
    failed: int = 0
    skipped_offline: int = 0
    total: int = 0
    resolved: int = 0
    unresolved: int = 0


def key_of(address: str | None) -> str:
    """As ``text.cache_key``: lower-case words."""
    return " ".join(re.findall("[a-z0-9]+", (address or "").lower()))


def variants(address: str, region: str | None = None) -> list[str]:
    """As ``text.query_variants``: the whole, from the first house number on, the last part."""
    whole = " ".join(address.split())
    if not whole:
        return []
    numbered = re.search(r"\b[0-9]+[a-zA-Z]?(?:\s*[-/]\s*[0-9]+)?\s+[A-Z][\w'-]*", whole)
    parts = [p.strip() for p in whole.split(",") if p.strip()]
    found = [whole, *([whole[numbered.start() :]] if numbered and numbered.start() else []), *(parts[-1:] if len(parts) > 1 else [])]
    return list(dict.fromkeys(f"{v}, {region}" if region else v for v in found))


def read_cache(path: str) -> dict:
    """Entries by key; a missing or broken file is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        return told["entries"] if isinstance(told.get("entries"), dict) else {}
    except (OSError, ValueError, AttributeError, KeyError):
        return {}


def write_cache(path: str, entries: dict) -> None:
    """In the order of the keys, so that versions of the file compare line by line."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    data = json.dumps({"version": 1, "entries": {k: entries[k] for k in sorted(entries)}}, indent=2, ensure_ascii=False) + "\n"
    fetch.replace_file(path, data.encode())


def as_frame(spark: SparkSession, entries: dict) -> DataFrame:
    """(key, result) for ``lookup.address_lookup``: null results were asked and not found."""
    place = lambda r: None if not r else (float(r["lat"]), float(r["lng"]), r.get("displayName"), r.get("type"))
    return spark.createDataFrame([(k, place(e.get("result"))) for k, e in sorted(entries.items())], SCHEMA)


def ask(query: str, get: Callable[..., bytes] = fetch.http_send) -> dict | None:
    """The first place that the service names for a text."""
    url = f"{SERVICE}?" + urllib.parse.urlencode({"q": query, "format": "jsonv2", "limit": "1", "countrycodes": "au", "addressdetails": "0"})
    found = json.loads(get(url, None, {"user-agent": AGENT, "accept": "application/json"}))
    if not isinstance(found, list) or not found:
        return None
    try:
        lat, lng = float(found[0]["lat"]), float(found[0]["lon"])
    except (KeyError, TypeError, ValueError):
        return None
    kind = ":".join(x for x in (found[0].get("category"), found[0].get("type")) if x)
    return {"lat": lat, "lng": lng, "displayName": found[0].get("display_name"), "type": kind or None}


def fill(addresses: list[str], path: str, region: str | None = None, offline: bool = False, get: Callable[..., bytes] = fetch.http_send, pause_s: float = PAUSE_S) -> Stats:
    """Look up the addresses that the cache does not know, one request a ``pause_s`` at most, and keep what came, failures too."""
    entries, stats, last = read_cache(path), Stats(), 0.0
    known = len(entries)
    unique = list(dict.fromkeys(a for a in addresses if a))
    stats.requested = len(unique)
    for a in unique:
        key = key_of(a)
        if key in entries:
            stats.from_cache += 1
            stats.failed += not entries[key].get("result")
            continue
        if offline:
            stats.skipped_offline += 1
            continue
        found, tried = None, []
        for v in variants(a, region):
            time.sleep(max(0.0, last + pause_s - time.monotonic()))
            last = time.monotonic()
            tried.append(v)
            try:
                found = ask(v, get)
            except (OSError, ValueError):
                found = None
            if found:
                break
        entries[key] = {"address": a, "queriedAt": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"), "attempted": tried, "result": found}
        stats.fetched += bool(found)
        stats.failed += not found
    if len(entries) > known:
        write_cache(path, entries)
    stats.total = len(entries)
    stats.resolved = sum(bool(e.get("result")) for e in entries.values())
    stats.unresolved = stats.total - stats.resolved
    return stats

"""Retrieval of raw files with a validated cache and a manifest; driver-side, outside Spark."""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

SECRET_PARAMS = re.compile(r"(?i)([?&](?:key|apikey|api_key|token|access_token)=)[^&]*")


@dataclass(frozen=True)
class Fetched:
    path: str
    url: str | None
    fetched_at: str | None
    changed: bool
    from_cache: bool
    stale: bool
    note: str = ""


def redact(url: str, secrets: tuple[str, ...] = ()) -> str:
    """The URL without secret values."""
    for s in secrets:
        if s:
            url = url.replace(s, "REDACTED")
    return SECRET_PARAMS.sub(r"\1REDACTED", url)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read_manifest(folder: str) -> dict:
    """The manifest; a missing or broken one is empty."""
    try:
        with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
            m = json.load(f)
        return m if isinstance(m.get("entries"), dict) else {"version": 1, "entries": {}}
    except (OSError, ValueError, AttributeError):
        return {"version": 1, "entries": {}}


def replace_file(path: str, data: bytes) -> None:
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)


def http_get(url: str, timeout: float = 60) -> bytes:
    return http_send(url, timeout=timeout)


def http_send(url: str, body: bytes | None = None, headers: dict | None = None, timeout: float = 300) -> bytes:
    """The answer to a GET, or to a POST of ``body``."""
    with urllib.request.urlopen(urllib.request.Request(url, body, headers or {}), timeout=timeout) as r:
        return r.read()


def retrieve(key: str, urls: list[str], folder: str, validate: Callable[[bytes], str | None] | None = None, offline: bool = False, get: Callable[[str], bytes] = http_get, secrets: tuple[str, ...] = ()) -> Fetched:
    """Get ``key`` from the first mirror whose content passes ``validate``.

    Content is checked before the cache is touched.  Without a good answer the
    cached file serves as a stale one; without that, an error names every
    attempt.  Offline only the cache is used; a file that no longer fits its
    recorded digest is noted, not refused.
    """
    os.makedirs(folder, exist_ok=True)
    path, m = os.path.join(folder, key), read_manifest(folder)
    old = m["entries"].get(key, {})
    if offline:
        if not os.path.exists(path):
            raise FileNotFoundError(f"{key} is not in the cache and the run is offline")
        with open(path, "rb") as f:
            fits = digest(f.read()) == old.get("sha256", "")
        return Fetched(path, old.get("url"), old.get("fetchedAt"), False, True, False, "" if fits or not old else "checksum differs from the manifest")
    tried = []
    for url in urls:
        try:
            data = get(url)
            why = validate(data) if validate else None
            if why:
                raise ValueError(why)
        except Exception as e:
            tried.append(f"{redact(url, secrets)}: {e}")
            continue
        now, sha = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"), digest(data)
        changed = bool(old) and old.get("sha256") != sha
        replace_file(path, data)
        m["entries"][key] = {"url": redact(url, secrets), "fetchedAt": now, "sha256": sha, "bytes": len(data), "previousSha256": old.get("sha256"), "previousBytes": old.get("bytes"), "changed": changed}
        replace_file(os.path.join(folder, "manifest.json"), json.dumps(m, indent=1, sort_keys=True).encode())
        return Fetched(path, redact(url, secrets), now, changed, False, False)
    if os.path.exists(path):
        return Fetched(path, old.get("url"), old.get("fetchedAt"), False, True, True, "; ".join(tried))
    raise ConnectionError(f"{key}: " + "; ".join(tried))

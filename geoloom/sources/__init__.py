"""Source adapters and their registry."""

from __future__ import annotations

from geoloom.sources.adapters import ALL, DEFAULT_IDS, attribution, catalogue, select

__all__ = ["ALL", "DEFAULT_IDS", "attribution", "catalogue", "select"]

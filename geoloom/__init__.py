"""Location data integration and query engine on Spark.

The usual entry points are gathered here and loaded when they are asked for, so
that a worker that needs one module does not pay for all; each module has more.
"""

from importlib import import_module

_FOUND_IN = {
    "MatchConfig": "geoloom.operators.resolve", "SiteQuery": "geoloom.operators.search", "load": "geoloom.ingest", "nearest": "geoloom.operators.search",
    "resolve": "geoloom.operators.resolve", "run_sources": "geoloom.ingest", "save": "geoloom.ingest", "search": "geoloom.operators.search",
}
__all__ = sorted(_FOUND_IN)


def __getattr__(name: str):
    if name not in _FOUND_IN:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_FOUND_IN[name]), "ingest" if name == "run_sources" else name)

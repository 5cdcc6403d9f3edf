"""The serving surface as functions: each gives a plain dict, errors carry a code and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom import export
from geoloom.operators import drift, rollups, search

# Error code -> HTTP status.
STATUS = {"BAD_QUERY": 400, "NOT_FOUND": 404, "METHOD_NOT_ALLOWED": 405, "INTERNAL": 500, "DATASET_UNAVAILABLE": 503}


class ServiceError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.status = code, STATUS[code]


class Service:
    """Over one dataset of sites and its metadata."""

    def __init__(self, sites: DataFrame | None, meta: dict):
        self._sites, self._meta = sites, meta

    @property
    def sites(self) -> DataFrame:
        if self._sites is None:
            raise ServiceError("DATASET_UNAVAILABLE", "no dataset is loaded")
        return self._sites

    def health(self) -> dict:
        return {"ok": True, "sites": self.sites.count()}

    def meta(self) -> dict:
        return {k: v for k, v in self._meta.items() if k != "sites"}

    def search(self, params: dict) -> dict:
        """A page with its totals and facets; both read one cached set of matches."""
        try:
            q = search.from_params(params)
        except ValueError as e:
            raise ServiceError("BAD_QUERY", str(e)) from e
        m = search.matched(self.sites, q).cache()
        try:
            rows = [r.asDict(True) for r in search.page(m, q).collect()]
            facets: dict[str, dict[str, int]] = {}
            for r in search.facets(m).collect():
                facets.setdefault(r.facet, {})[r.value] = r.n
            return {"total": m.count(), "sort": q.order, "returned": len(rows), "facets": facets, "sites": rows}
        finally:
            m.unpersist()

    def site(self, site_id: str, as_of: str) -> dict:
        found = search.by_id(self.sites, site_id)
        row = found.first()
        if row is None:
            raise ServiceError("NOT_FOUND", f"no site {site_id}")
        age = drift.provenance_staleness(found, F.lit(as_of).cast("timestamp")).collect()
        return row.asDict(True) | {"staleness": {r.field: {"age_days": r.age_days, "budget_days": r.budget_days, "stale": r.stale} for r in age}}

    def nearest(self, lat: float, lng: float, n: int = 5) -> list[dict]:
        try:
            return [r.asDict(True) for r in search.nearest(self.sites, lat, lng, n).collect()]
        except ValueError as e:
            raise ServiceError("BAD_QUERY", str(e)) from e

    def stats(self) -> dict:
        totals = rollups.coverage_totals(self.sites).first().asDict()
        by: dict[str, dict[str, int]] = {}
        for r in rollups.coverage_counts(self.sites).where("dimension <> 'operator'").collect():
            by.setdefault(r.dimension, {})[r.value] = r.n
        return totals | {"by": by, "top_operators": [r.asDict() for r in rollups.top_operators(self.sites).collect()]}

    def export(self, fmt: str, path: str) -> list[str]:
        try:
            return export.write(self.sites, fmt, path, self._meta)
        except ValueError as e:
            raise ServiceError("BAD_QUERY", str(e)) from e

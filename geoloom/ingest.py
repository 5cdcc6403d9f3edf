"""The whole run: sources to sites, with its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom import sources
from geoloom.operators import rollups
from geoloom.operators.resolve import MatchConfig, resolve
from geoloom.schema import ISSUE, RECORD, conform, struct_of
from geoloom.sources.adapters import Context
from geoloom.storage import materialize


@dataclass(frozen=True)
class Run:
    """Records, issues and counts of a run; sites are resolved once, when they or their counts are first asked for."""

    records: DataFrame
    issues: DataFrame
    source_stats: DataFrame
    cfg: MatchConfig
    exclude_planned: bool

    @cached_property
    def _resolved(self) -> tuple[DataFrame, DataFrame]:
        return resolve(conform(self.records), self.cfg)

    @property
    def sites(self) -> DataFrame:
        return without_planned(self._resolved[0]) if self.exclude_planned else self._resolved[0]

    @property
    def resolution(self) -> DataFrame:
        return self._resolved[1]


def without_planned(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("status") != "planned")


def ingest(spark: SparkSession, paths: dict[str, str], ctx: Context, cfg: MatchConfig = MatchConfig(), exclude_planned: bool = False) -> Run:  # noqa: B008
    """Read every source in ``paths`` (id -> file) and count; the run resolves when asked for its sites.

    A source that is refused or fails is reported with its error; the others go
    on.
    """
    records = spark.createDataFrame([], struct_of(RECORD))
    issues = spark.createDataFrame([], struct_of(ISSUE))
    errors = []
    for s in sources.select(list(paths)):
        try:
            why = s.validate(spark, paths[s.id], ctx)
            if why:
                raise ValueError(why)
            r, i = s.read(spark, paths[s.id], ctx)
            r, i = materialize(r), materialize(i)
        except Exception as e:  # one bad source must not end the run
            errors.append((s.id, str(e).splitlines()[0][:300]))
            continue
        records, issues = records.unionByName(r), issues.unionByName(i)
    bad = spark.createDataFrame(errors, "source_id string, error string")
    stats = rollups.source_stats(records, issues).join(bad, "source_id", "full")
    return Run(records, issues, stats, cfg, exclude_planned)


def save(run: Run, path: str) -> None:
    """Write the run's tables; sites in the order of their ids."""
    for name in ("sites", "records", "issues", "source_stats", "resolution"):
        d = getattr(run, name)
        (d.orderBy("id") if name == "sites" else d).write.mode("overwrite").parquet(f"{path}/{name}")
    rollups.dataset_counts(run.records, run.sites, run.resolution).write.mode("overwrite").parquet(f"{path}/counts")


def load(spark: SparkSession, path: str, name: str = "sites") -> DataFrame | None:
    """A saved table; sites must be there, others may be missing."""
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as e:
        if name == "sites":
            raise FileNotFoundError(f"no dataset at {path}") from e
        return None

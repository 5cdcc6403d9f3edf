"""Incremental re-resolution over an append-only folder of records.

A stream appends records and notes the grid cells that they can change.
``refresh`` then resolves anew only what those cells touch: pairs among old
records never change, and a new record links to records in its neighbourhood
only, so the clusters with a member in a touched cell, and the new records, are
all that can differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.functions import geo
from geoloom.operators.resolve import MatchConfig, candidate_pairs, clusters, links, merge, number_collisions, score_pairs, slug_id, usable
from geoloom.schema import RECORD, conform, struct_of


def read_records(spark: SparkSession, path: str, watermark: str = "1 day") -> DataFrame:
    """The stream of new records, a record's repeats within the watermark dropped."""
    d = spark.readStream.schema(struct_of(RECORD)).parquet(path)
    return d.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["source_id", "source_record_id"])


def touched_cells(batch: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """(gy, gx): grid cells that a batch's records can change, with their neighbours."""
    row, col = geo.cell(F.col("lat"), F.col("lng"), cfg.cell_m)
    near = F.sequence(F.lit(-1), F.lit(1))
    d = batch.where(geo.is_valid(F.col("lat"), F.col("lng"), cfg.any_turn)).select(F.explode(F.transform(near, lambda x: row + x)).alias("gy"), col.alias("x"))
    return d.select("gy", F.explode(F.transform(near, lambda x: F.col("x") + x)).alias("gx")).distinct()


def start(stream: DataFrame, store: str, checkpoint: str, cfg: MatchConfig = MatchConfig()) -> StreamingQuery:  # noqa: B008
    """Append each micro-batch to ``store``/records and note the cells it touched in ``store``/touched."""

    def each(batch: DataFrame, number: int) -> None:
        # folders by batch number make a repeated batch replace itself
        batch.write.mode("overwrite").parquet(f"{store}/records/batch={number}")
        touched_cells(batch, cfg).write.mode("overwrite").parquet(f"{store}/touched/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _near(records: DataFrame, cells: DataFrame, cfg: MatchConfig) -> DataFrame:
    """rid of the records that stand in one of the cells, or one column beside it.

    Columns are cut at each row's own latitude, so a cell's neighbours to the
    north and south may be numbered one column off.
    """
    row, col = geo.cell(F.col("lat"), F.col("lng"), cfg.cell_m)
    wide = cells.select("gy", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1)).alias("gx")).distinct()
    return records.select("rid", row.alias("gy"), col.alias("gx")).join(wide, ["gy", "gx"], "left_semi").select("rid")


def refresh(spark: SparkSession, store: str, version: int, cfg: MatchConfig = MatchConfig()) -> DataFrame:  # noqa: B008
    """Sites after the records that came since version ``version - 1``; written as version ``version``.

    ``store``/state/<version> holds members (rid, cluster_id, seen) and sites; ``seen`` is
    the last batch that the version knows.  The first version resolves everything.
    """
    old, new = f"{store}/state/{version - 1}", f"{store}/state/{version}"
    stored = spark.read.schema(struct_of(RECORD | {"batch": "bigint"})).parquet(f"{store}/records")
    last = stored.agg(F.max("batch")).first()[0]
    # a record that came again is told by its last batch
    newest = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("batch"), F.desc("fetched_at")))
    records = usable(conform(stored.withColumn("_n", newest).where("_n = 1")), cfg)
    if version == 0:
        part, kept_members, kept_sites = records, None, None
    else:
        members, sites = spark.read.parquet(f"{old}/members"), spark.read.parquet(f"{old}/sites")
        seen = members.agg(F.max("seen")).first()[0]
        seen = -1 if seen is None else seen
        cells = spark.read.parquet(f"{store}/touched").where(F.col("batch") > seen).select("gy", "gx")
        hit = _near(records, cells, cfg).join(members, "rid").select("cluster_id").distinct()
        again = members.join(hit, "cluster_id", "left_semi").select("rid")
        fresh = records.join(members, "rid", "left_anti").select("rid")
        part = records.join(again.unionByName(fresh).distinct(), "rid", "left_semi")
        kept_members, kept_sites = members.join(hit, "cluster_id", "left_anti"), sites.join(hit, "cluster_id", "left_anti")
    membership = clusters(part, links(score_pairs(candidate_pairs(part, cfg), cfg), cfg)).withColumn("seen", F.lit(last).cast("long"))
    changed = merge(part, membership.drop("seen"), cfg)
    out_members = membership if kept_members is None else kept_members.withColumn("seen", F.lit(last).cast("long")).unionByName(membership)
    out_sites = changed if kept_sites is None else kept_sites.unionByName(changed)
    # ids are numbered over all sites, whichever version they come from
    out_sites = number_collisions(out_sites.withColumn("id", slug_id(F.col("lat"), F.col("lng"), F.col("operator"))))
    out_members.write.mode("overwrite").parquet(f"{new}/members")
    out_sites.write.mode("overwrite").parquet(f"{new}/sites")
    return spark.read.parquet(f"{new}/sites")

"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node it reaches.

    Each round hangs every node under its smallest neighbour, follows two
    more steps up, and contracts the edges to the roots found; only edges
    between different roots stay.  The number of rounds grows with the
    logarithm of a component's diameter.  A round writes what it found out and
    the edges that are left to shared storage, so lineage stays short; the
    nodes go through all rounds' tables at the end, in one pass.  Null ends and
    loops give no edge; a node that only has loops is its own component.
    """
    e = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = materialize(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not e.isEmpty():
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x"))
        up = both.groupBy(F.col("x.v").alias("v")).agg(F.min("x.u").alias("m"))
        up = up.select("v", F.least("v", "m").alias("p"))
        for _ in range(2):
            step = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = up.join(step, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        up = materialize(up)
        rounds.append(up)
        ra, rb = up.select(F.col("v").alias("a"), F.col("p").alias("ra")), up.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        e = e.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        e = materialize(e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    found = nodes.select("node", F.col("node").alias("component"))
    for up in rounds:
        found = found.join(up, found.component == up.v, "left").select("node", F.coalesce("p", "component").alias("component"))
    return materialize(found)

"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a
hub with any number of neighbours is never gathered in one task.  Tables are
written to the shared folder after each round, which ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shuffle import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v): small keeps neighbours below u, large sends those above u to the minimum."""
    if small:
        directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        directed = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = directed.join(low, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of comparable ids -> (id, component): the smallest id reachable.

    Ids without an edge to another id are absent; nulls and self edges are ignored."""
    edges = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = cut(_star(_star(edges, small=False), small=True), "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = seen

"""Connected components of an edge table, with alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every step is a pre-aggregated
minimum per node and a join back to the edges. The minima are written first: then both sides of the
join are dealt for the join alone and Spark can split the partition of a hub. Nothing is collected
but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.plans.tables import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            break
        before = state
        edges = materialise(_small_star(materialise(_large_star(edges).distinct(), "edges")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

"""Connected components of an edge table, by alternating large and small stars.

Every round is a minimum per node (with map-side combining) and a join back on the node; edges
stay as many as there were at most. Rounds end when the edges are stars around each component's
smallest node. Tables of each round are stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs: (u, v). Links what surrounds u to the smallest node around u, u counted."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = pairs.join(low, "u")
    if larger:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges: (u, v) of longs, any direction, repeated or not, loops ignored. Returns (node,
    component), component being its smallest node, for each node that has an edge."""
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    said = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True).distinct()
        now = materialize(_star(large, larger=False).distinct(), "edges")
        # Sums in decimals can't overflow; two equal digests mean that the stars stand still.
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == said:
            break
        said = digest
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step is one aggregation and one join on the
node; the aggregation's result is checkpointed first, so that both sides of the join are plain shuffles whose hot nodes
Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import checkpoint


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _directed(edges)
    least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("w"), "m"))
    return both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpoint(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"))
    moved = down.join(least, down["u"] == least["w"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for every id that occurs in an edge.

    Edges are undirected; loops, repeats and edges with a null end are allowed and ignored, except that an id with only a
    loop is its own component.
    """
    # Whatever finds the edges runs once: they are written before loops are told from the others.
    pairs = checkpoint(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null").distinct())
    current = pairs.where("u <> v")
    loops = pairs.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    seen = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        current = checkpoint(_small_star(checkpoint(_large_star(current))))
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.union(roots).union(loops).groupBy("id").agg(F.min("component").alias("component"))

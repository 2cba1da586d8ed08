"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.storage import drop_path, stored_at


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): every node of the edges (u, v) with the least node that it is connected to.

    Alternates large stars (each node's greater neighbours turn to its least neighbour) and small stars (its
    smaller ones do) until the edges are stars. Each round is written once, and the one before it dropped; the
    rounds grow with the logarithm of the longest path. Self-loops and repeated edges do no harm; nodes are never null, of any type with an order.
    Raises if the edges still change after most_rounds rounds.
    """
    spark = edges.sparkSession
    edges, path = stored_at(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = edges.agg(*state).first()
    for _ in range(most_rounds):
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, now_at = stored_at(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(*state).first()
        drop_path(spark, path)
        path = now_at
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )

"""Crawling as a fixpoint over a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.storage import stored


def crawl_fixpoint(seeds: DataFrame, edges: DataFrame, rounds: int = 6, least_new: int = 1) -> DataFrame:
    """url and round of every page reachable from the seeds within so many rounds.

    A round joins only the frontier (pages new in the round before) with the edges (src, dst), and is written
    once: lineage doesn't grow and a lost executor re-reads. Stops when a round finds fewer than least_new.
    """
    seen = stored(seeds.select("url").distinct().withColumn("round", F.lit(0)), "crawl")
    frontier, parts = seen, [seen]
    for k in range(1, rounds + 1):
        found = frontier.join(edges, frontier["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        new = stored(found.join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(k)), "crawl")
        if new.count() < least_new:
            break
        parts.append(new)
        seen, frontier = seen.unionByName(new), new
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

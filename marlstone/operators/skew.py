"""Joins on keys of which one may hold a large share of the rows, and how many tasks many rows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task that sorts or groups rows which hardly combine.
TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame, each: int = TASK_ROWS) -> int:
    """The session's shuffle partitions, or as many as leave each of them that many of the rows, if that is more."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def join_spread(many: DataFrame, few: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """many joined with few, which has one row for each key; a hot key's rows are dealt over several tasks.

    A key is hot if it has more rows than an average shuffle partition. There are fewer such keys than shuffle
    partitions, so their list is broadcast. A hot key's rows go to as many parts, by the hash of by (a column of
    many), as it has partitions' worth of rows, and its row of few goes to each part. how: inner or left.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = many.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNotNull())
    total = F.lit(many.count())
    hot = counts.filter(F.col("n") * parts > total).select(F.col(key).alias("_hot"), F.ceil(F.col("n") * parts / total).cast("int").alias("_parts"))
    hot = F.broadcast(hot)
    part = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")
    left = many.join(hot, many[key] == F.col("_hot"), "left").withColumn("_part", part).drop("_hot", "_parts")
    right = few.join(hot, few[key] == F.col("_hot"), "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return left.join(right, [key, "_part"], how).drop("_part")

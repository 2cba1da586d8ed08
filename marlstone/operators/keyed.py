"""Keyed merges on immutable tables: the result is a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Old and new rows, the latest version of each key; a replay changes nothing. At equal versions new wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in version], F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows, and the first new row of each key that old lacks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in gone: cascades, resets, candidates not yet processed."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def first_source(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """The value of the best-ranked source that has one: fallbacks in order."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(value, rank), rank).alias("b")).select(*keys, f"b.{value}", f"b.{rank}")

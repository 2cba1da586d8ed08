"""Aggregates kept as states that merge: what has arrived adds to what is there, and nothing is read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.keyed_table import KeyedTable, Merged

#: State of an asset's day: what mean, deviation, last price and extremes are made of.
DAILY_STATE = "asset_id long, trade_date date, n long, total double, squares double, low double, high double, last struct<ts:timestamp,quote_id:long,price:double>"


def daily_state(quotes: DataFrame) -> DataFrame:
    """The states of the quotes (quote_id, asset_id, ts, price): one for each asset and day."""
    last = F.max(F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("quote_id").cast("long").alias("quote_id"), F.col("price").cast("double").alias("price")))
    price = F.col("price").cast("double")
    rows = quotes.filter("asset_id is not null and ts is not null").groupBy(F.col("asset_id").cast("long").alias("asset_id"), F.to_date("ts").alias("trade_date"))
    return rows.agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.sum(price * price).alias("squares"), F.min(price).alias("low"), F.max(price).alias("high"), last.alias("last"))


def combined(states: DataFrame) -> DataFrame:
    """One state of those of the same asset and day; their order plays no part but for rounding."""
    g = states.groupBy("asset_id", "trade_date")
    return g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"))


def merged_states(old: DataFrame, new: DataFrame) -> DataFrame:
    return combined(old.unionByName(new))


def daily_figures(states: DataFrame) -> DataFrame:
    """asset_id, trade_date, price (last), volume (quotes), mean, deviation, low and high."""
    mean = F.col("total") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    return states.select("asset_id", "trade_date", F.col("last.price").alias("price"), F.col("n").alias("volume"), mean.alias("mean"), deviation.alias("deviation"), "low", "high")


def weekly_figures(states: DataFrame) -> DataFrame:
    """The same by week (its Monday), from the days' states."""
    weeks = states.withColumn("trade_date", F.date_trunc("week", "trade_date").cast("date"))
    return daily_figures(combined(weeks)).withColumnRenamed("trade_date", "week")


def state_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    return KeyedTable(spark, path, spark.createDataFrame([], DAILY_STATE).schema, ("asset_id", "trade_date"), buckets)


class Kept:
    """Takes batches of quotes, of a stream or by hand, into a state table; a batch that comes again is left out by its number.

    A batch is read once and reduced before it meets the table, of which only the buckets with its keys are rewritten.
    """

    def __init__(self, table: KeyedTable, name: str = "quotes", state: Callable[[DataFrame], DataFrame] = daily_state, merge: Callable[[DataFrame, DataFrame], DataFrame] = merged_states):
        self.table, self.name, self.state, self.merge, self.done = table, name, state, merge, []

    def __call__(self, batch: DataFrame, number: int) -> Merged:
        self.done.append(self.table.merge(self.state(batch), f"{self.name}-{number}", self.merge))
        return self.done[-1]

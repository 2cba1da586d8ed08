"""Incremental feeds: each is the batch operator on what has arrived, with idempotent keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import market


def read_feed(spark: SparkSession, path: str, schema, files_each: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Landed files as a stream, a few in each batch; the checkpoint replaces a cursor of its own."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", pattern).parquet(path)


def in_event_time(rows: DataFrame, column: str, late: str) -> DataFrame:
    """A watermark; tables' local times become timestamps of the session's zone first, which it needs. Windows are UTC's."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def daily_snapshots(quotes: DataFrame, late: str = "1 day") -> DataFrame:
    """Last quote of each asset and day, complete once the watermark passes the day."""
    rows = in_event_time(quotes, "ts", late)
    last = F.max_by("price", F.struct("ts", "quote_id"))
    g = rows.groupBy(F.window("ts", "1 day"), "asset_id").agg(last.alias("price"), F.count("*").alias("volume"))
    return g.select("asset_id", F.to_date("window.start").alias("trade_date"), "price", "volume")


def deduplicated(posts: DataFrame, keys: list[str], column: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each key; its state goes once the watermark passes."""
    return in_event_time(posts, column, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, out: str | None = None, mode: str = "append") -> StreamingQuery:
    """All that has landed, in as many batches as the source gives, then stops."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", out)).start()
    q.awaitTermination()
    return q


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key ever: the keys seen are the stream's state, so no batch rereads what earlier ones gave."""
    return rows.dropDuplicates(keys)


class AlertOnce:
    """Lands each batch's alerts in a folder of its own and sends them; a replay of a batch overwrites its folder. Takes first_of_each rows."""

    def __init__(self, spark: SparkSession, path: str, schema, send: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.schema, self.send = spark, path, schema, send

    def sent(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.select(*[f.name for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if self.send:
            self.send(self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={number}"))


def rolling(rows: DataFrame, value: str, keys: list[str], late: str = "1 day", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Sums over sliding windows of event time."""
    g = in_event_time(rows, "ts", late).groupBy(F.window("ts", size, slide), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), "total", "n")


def daily_returns_of_batch(quotes: DataFrame) -> DataFrame:
    return market.returns(market.daily_last(quotes))


def interval_joined(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: str, after: str = "0 seconds", late: str = "1 day", how: str = "leftOuter") -> DataFrame:
    """Left rows with the right rows of their key from before their time to after it; columns of the two sides differ, but for the key.

    Both sides have a watermark, so Spark drops from its state what no later row can meet; a left row without a match
    comes once the right side's watermark has passed the end of its interval.
    """
    l = in_event_time(left, left_time, late).withColumnRenamed(key, "_key")
    r = in_event_time(right, right_time, late)
    inside = (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {before}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {after}"))
    return l.join(r, (F.col("_key") == F.col(key)) & inside, how).drop(key).withColumnRenamed("_key", key)

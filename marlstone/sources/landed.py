"""Landed responses of outside services: raw JSON, checkpoints, sitemaps, files, registered feeds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = "source string, key string, fetched_at timestamp, payload string"


def land(rows: DataFrame, path: str) -> None:
    """Appends raw responses (source, key, fetched_at, payload), one folder for each source."""
    rows.write.mode("append").partitionBy("source").json(path)


def landed(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    df = spark.read.schema(RAW).json(path)
    return df.filter(F.col("source") == source) if source else df


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """The payload's fields; a payload that doesn't parse gives nulls."""
    return rows.withColumn("_p", F.from_json("payload", schema)).select("source", "key", "fetched_at", "_p.*")


def latest(rows: DataFrame) -> DataFrame:
    """The newest response of each source and key; ties go to the greater payload."""
    return rows.groupBy("source", "key").agg(F.max(F.struct("fetched_at", "payload")).alias("m")).select("source", "key", "m.*")


def unfinished(targets: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that no checkpoint line names: a batch resumes where it stopped."""
    return targets.join(done.select(*keys).distinct(), keys, "left_anti")


def checkpointed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a JSON checkpoint; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc and lastmod of all addresses in landed sitemap files."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return df.select(F.trim("loc").alias("loc"), "lastmod").filter("loc is not null")


def files_as_text(spark: SparkSession, path: str, extract: Callable[[bytes], str], most_chars: int = 2500) -> DataFrame:
    """path and text of binary files (PDF and others) by the extractor given; a file that it can't read, whatever it raises, has null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    out.append(extract(bytes(content)))
                except Exception:  # of any reader's own type; one broken file must not end the job
                    out.append(None)
            yield pd.DataFrame({"path": b["path"], "text": out})

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    return df.withColumn("snippet", F.substring("text", 1, most_chars))


class _Reader(DataSourceReader):
    def __init__(self, fetch, keys: list[str]):
        self.fetch, self.keys = fetch, keys

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition):
        for item in self.fetch(partition.value):
            yield (partition.value, json.dumps(item, sort_keys=True))


def register_feed(spark: SparkSession, feed: str, fetch: Callable[[str], list[dict]]) -> None:
    """Makes spark.read.format(feed).option("keys", "a,b") read fetch(key) for each key, a partition each."""

    class Feed(DataSource):
        @classmethod
        def name(cls):
            return feed

        def schema(self):
            return "key string, payload string"

        def reader(self, schema):
            return _Reader(fetch, [k for k in self.options.get("keys", "").split(",") if k])

    spark.dataSource.register(Feed)


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table in ranges of its key; needs the driver's jar on the class path."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    return r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()

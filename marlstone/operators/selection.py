"""Which rows are worked on next, and what a round of work changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.entities import SECTOR_PRIORITY
from marlstone.operators.keyed import without


def collect_priority(sector: Column, default: int = 70) -> Column:
    """Collection priority of a sector; default for those without one and for null."""
    out = F.lit(default)
    for s, p in SECTOR_PRIORITY.items():
        out = F.when(sector == s, p).otherwise(out)
    return out


def gap_rank(material: Column, sector: Column, topics: dict[str, list[str]], first: str = "official_website") -> Column:
    """Place of a missing material in its asset's list: first topmost, then the sector's own order, the rest after it."""
    rest = max(map(len, topics.values()), default=0) + 1
    out = F.lit(rest)
    for s, order in topics.items():
        place = F.array_position(F.array(*map(F.lit, order)), material).cast("int")
        out = F.when(sector == s, F.when(place > 0, place).otherwise(rest)).otherwise(out)
    return F.when(material == first, 0).otherwise(out)


def next_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows by key after the last one seen (null: from the start); the filter reaches the scan."""
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(size)


def gap_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change of every key that a round of filling closed (in before only) or opened (in after only)."""
    closed = without(before.select(*keys).distinct(), after, keys).withColumn("change", F.lit("closed"))
    return closed.unionByName(without(after.select(*keys).distinct(), before, keys).withColumn("change", F.lit("opened")))


def crowded(links: DataFrame, most: int = 500, key: str = "asset_id") -> DataFrame:
    """key and n of the assets with more than most links."""
    return links.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def reset_crowded(links: DataFrame, most: int = 500, key: str = "asset_id", source: str = "source", kind: str = "deep_crawl") -> DataFrame:
    """The links without those of a kind of source that belong to crowded assets; links of unknown source stay."""
    over = crowded(links, most, key).select(key).withColumn("_over", F.lit(True))
    hit = F.coalesce(F.col("_over") & (F.col(source) == kind), F.lit(False))
    return links.join(over, key, "left").filter(~hit).select(*links.columns)


def append_version(old: DataFrame, new: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Old rows, and each key's new row with the version after its last; keys not seen start at 1."""
    last = old.groupBy(key).agg(F.max(version).alias("_last"))
    rows = new.join(last, key, "left").withColumn(version, (F.coalesce("_last", F.lit(0)) + 1).cast(old.schema[version].dataType)).drop("_last")
    return old.unionByName(rows)

"""Posts of authors: the assets they name, lists of them, and the facts that an alert is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.entities import base_symbol


def named_assets(posts: DataFrame, assets: DataFrame, aliases: DataFrame) -> DataFrame:
    """posts with asset_id and matched_by: exact symbol, then alias, then symbol without its trading pair; null: none.

    posts: symbol; assets: asset_id, symbol; aliases: alias, asset_id. Case plays no part. Of assets with the same
    symbol or alias the least id is named. Distinct names are matched, so a hot one is a row.
    """
    one = lambda rows, c: rows.groupBy(F.upper(c).alias("name")).agg(F.min("asset_id").alias("id"))
    symbols, others = one(assets, "symbol"), one(aliases, "alias")
    names = posts.select(F.upper("symbol").alias("said")).filter("said is not null").distinct().withColumn("base", base_symbol(F.col("said")))
    hit = lambda rows, on, c: rows.select(F.col("name").alias(on), F.col("id").alias(c))
    names = names.join(hit(symbols, "said", "a"), "said", "left").join(hit(others, "said", "b"), "said", "left").join(hit(symbols, "base", "c"), "base", "left")
    by = F.when(F.col("a").isNotNull(), "symbol").when(F.col("b").isNotNull(), "alias").when(F.col("c").isNotNull(), "pair")
    names = names.select("said", F.coalesce("a", "b", "c").alias("asset_id"), by.alias("matched_by"))
    return posts.join(names, F.upper("symbol") == F.col("said"), "left").drop("said")


def listed(posts: DataFrame, **wanted: list | None) -> DataFrame:
    """Posts whose columns have one of the values wanted; none given: all. Filters reach the scan."""
    for column, values in wanted.items():
        if values is not None:
            posts = posts.filter(F.col(column).isin(*values))
    return posts


def latest(rows: DataFrame, key: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """key and the values, under new names, of its last row by order; equal rows by order: the greatest values."""
    last = F.max(F.struct(*order, *[F.col(c).alias(f"_{n}") for n, c in values.items()])).alias("last")
    return rows.groupBy(key).agg(last).select(key, *[F.col(f"last._{n}").alias(n) for n in values])


def enriched(signals: DataFrame, facts: list[DataFrame], key: str = "asset_id") -> DataFrame:
    """Signals with each fact of their asset, null where there is none. facts: one row of each key."""
    for f in facts:
        signals = signals.join(f, key, "left")
    return signals


def author_stats(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """author, followers, signals and win_rate (of the signals with a result) of every author of a profile."""
    n = posts.groupBy("author").agg(F.count("*").alias("signals"), F.avg((F.col("result") > 0).cast("double")).alias("win_rate"))
    return profiles.join(n, "author", "left").select("author", "followers", F.coalesce("signals", F.lit(0)).alias("signals"), "win_rate")

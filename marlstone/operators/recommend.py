"""Daily recommendations: scores of what is known on the day, an archive of them, and how they turned out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.market import day_number
from marlstone.sources.keyed_table import KeyedTable, Merged

#: What an archived recommendation has; its keys are the day, the symbol and the chain.
ARCHIVE = "rec_date date, symbol string, chain string, asset_id long, sector string, price double, score double, consensus string"
KEYS = ("rec_date", "symbol", "chain")
DIMENSIONS = ("volume", "momentum", "buy_ratio", "change", "txns")


def features(daily: DataFrame, days: int = 7) -> DataFrame:
    """The five dimensions, 0 to 100, of each asset and day, from rows of that day and the days before.

    daily: asset_id, trade_date, price, volume, buys, sells. A window looks back only, so a day's features never
    change with what comes later.
    """
    asset = Window.partitionBy("asset_id").orderBy("trade_date")
    back = Window.partitionBy("asset_id").orderBy(day_number(F.col("trade_date"))).rangeBetween(-(days - 1), 0)
    swing = lambda x: 50 + 50 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    change = F.try_divide(F.col("price"), F.lag("price").over(asset)) - 1
    momentum = F.try_divide(F.col("price"), F.first("price").over(back)) - 1
    buys, sells = F.sum("buys").over(back), F.sum("sells").over(back)
    return daily.select(
        "asset_id", "trade_date", "price", F.least(F.lit(100.0), F.sum("volume").over(back) * 2.0).alias("volume"), swing(momentum).alias("momentum"),
        F.coalesce(F.try_divide(100.0 * buys, buys + sells), F.lit(50.0)).alias("buy_ratio"), swing(change).alias("change"), F.least(F.lit(100.0), F.col("volume") * 10.0).alias("txns"),
    )


def scored(rows: DataFrame, weights: DataFrame, default: float = 0.2) -> DataFrame:
    """Adds score: the dimensions by their sector's weights (sector and a column for each), the default for sectors without any."""
    w = weights.select(F.col("sector"), *[F.col(d).cast("double").alias(f"_{d}") for d in DIMENSIONS])
    total = sum((F.coalesce(F.col(f"_{d}"), F.lit(default)) * F.col(d) for d in DIMENSIONS[1:]), F.coalesce(F.col("_volume"), F.lit(default)) * F.col("volume"))
    return rows.join(w, "sector", "left").withColumn("score", F.round(total, 6)).drop(*[f"_{d}" for d in DIMENSIONS])


def daily_best(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each day by score, then asset, and of these the best of each symbol and chain; rows: scored, with symbol, chain, consensus."""
    day = Window.partitionBy("trade_date").orderBy(F.desc("score"), "asset_id")
    same = Window.partitionBy("trade_date", "symbol", "chain").orderBy(F.desc("score"), "asset_id")
    best = rows.withColumn("_n", F.row_number().over(day)).filter(F.col("_n") <= k)
    best = best.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return best.select(F.col("trade_date").alias("rec_date"), "symbol", "chain", "asset_id", "sector", "price", "score", "consensus")


def archive_table(spark, path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, path, spark.createDataFrame([], ARCHIVE).schema, KEYS, buckets)


def archive(table: KeyedTable, best: DataFrame, batch: str) -> Merged:
    """A run's recommendations into the archive: one for each day, symbol and chain; the run that came first stays, a repeated batch does nothing."""
    return table.merge(best, batch, order=[F.lit(0)], combine=lambda old, new: old.unionByName(new.join(old.select(*KEYS), list(KEYS), "left_anti")))


def band(score: Column) -> Column:
    return F.when(score >= 70, ">=70").when(score >= 50, "50-70").otherwise("<50")


def outcomes(recs: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """recs with band, held (the last price by the archived one, less one) and ret_<h>: the same h days after, null without a price then.

    prices: asset_id, trade_date, price. An equi-join for each day after, none for a range.
    """
    last = prices.groupBy("asset_id").agg(F.max_by("price", "trade_date").alias("_now"))
    out = recs.withColumn("band", band(F.col("score"))).join(last, "asset_id", "left").withColumn("held", F.try_divide(F.col("_now"), F.col("price")) - 1).drop("_now")
    for h in horizons:
        then = prices.select("asset_id", F.date_sub("trade_date", h).alias("rec_date"), F.col("price").alias("_then"))
        out = out.join(then, ["asset_id", "rec_date"], "left").withColumn(f"ret_{h}", F.try_divide(F.col("_then"), F.col("price")) - 1).drop("_then")
    return out


def figures(ret: Column) -> list[Column]:
    """n, mean, win rate, median, profit factor, best and worst of a return."""
    gain, loss = F.sum(F.when(ret > 0, ret).otherwise(0.0)), -F.sum(F.when(ret < 0, ret).otherwise(0.0))
    return [
        F.count(ret).alias("n"), F.round(F.avg(ret), 6).alias("mean_return"), F.round(F.avg((ret > 0).cast("int")), 6).alias("win_rate"), F.round(F.median(ret), 6).alias("median_return"),
        F.round(F.try_divide(gain, loss), 6).alias("profit_factor"), F.round(F.max(ret), 6).alias("best"), F.round(F.min(ret), 6).alias("worst"),
    ]

"""Derivatives of an asset over exchanges and days, as one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.market import day_number
from marlstone.storage import stored

METRICS = ("oi", "funding", "funding_7d", "funding_30d", "oi_change_24h", "oi_change_7d", "cvd", "long_short")


def by_day(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """asset_id, day, exchanges, oi (total over them), funding (weighted by it), buys and sells of every asset and day.

    rows: asset_id, exchange, day, oi, funding, taker_buy, taker_sell. Sums combine before the shuffle; funding is null
    without open interest. parts: where few rows share an asset's day, they are dealt once over so many tasks instead,
    and so are the days then, by asset.
    """
    g = (rows.repartition(parts, "asset_id", "day") if parts else rows).groupBy("asset_id", "day")
    days = g.agg(
        F.count_distinct("exchange").alias("exchanges"), F.sum("oi").alias("oi"), F.try_divide(F.sum(F.col("funding") * F.col("oi")), F.sum("oi")).alias("funding"),
        F.sum("taker_buy").alias("buys"), F.sum("taker_sell").alias("sells"),
    )
    return days.repartition(parts, "asset_id") if parts else days


def history(days: DataFrame) -> DataFrame:
    """The days with changes of open interest over 24 hours, 7 and 30 days, and mean funding of 7 and 30 days.

    A change is on the asset's last day that is at least so long ago, null without one; a mean is over the days there
    are within the window, its own day included.
    """
    order = Window.partitionBy("asset_id").orderBy(day_number(F.col("day")))
    ago = lambda n: F.try_divide(F.col("oi"), F.last("oi").over(order.rangeBetween(Window.unboundedPreceding, -n))) - 1
    mean = lambda n: F.avg("funding").over(order.rangeBetween(-(n - 1), 0))
    return days.withColumns({"oi_change_24h": ago(1), "oi_change_7d": ago(7), "oi_change_30d": ago(30), "funding_7d": mean(7), "funding_30d": mean(30)})


def answer(days: DataFrame, window: int = 30) -> DataFrame:
    """The eight metrics of each asset as of its last day, one row each: cvd (bought less sold) and long_short over the last window days."""
    order = Window.partitionBy("asset_id").orderBy(day_number(F.col("day"))).rangeBetween(-(window - 1), 0)
    buys, sells = F.sum("buys").over(order), F.sum("sells").over(order)
    rows = history(days).withColumns({"cvd": buys - sells, "long_short": F.try_divide(buys, sells)})
    last = rows.groupBy("asset_id").agg(F.max(F.struct("day", "exchanges", *METRICS)).alias("x"))
    return last.select("asset_id", F.col("x.day").alias("day"), F.col("x.exchanges").alias("exchanges"), *[F.col(f"x.{m}").alias(m) for m in METRICS])


def gathered(assets: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """The assets with the columns of every part (asset_id and figures, one row each), null where it has none, and have: how many parts do.

    Each part is stored first: the tasks that join them hold no sort of what a part is made of, and it is made once,
    however often the result is read.
    """
    have = F.lit(0)
    for name, rows in parts.items():
        assets = assets.join(stored(rows, f"part-{name}").withColumn(f"_{name}", F.lit(1)), "asset_id", "left")
        have = have + F.coalesce(F.col(f"_{name}"), F.lit(0))
    return assets.withColumn("have", have).drop(*[f"_{n}" for n in parts])


def competitors(assets: DataFrame, size: str, most: int = 10) -> DataFrame:
    """target, position and the columns of assets: every asset as a target comes first, then the greatest of its sector by size, most rows in all.

    assets: asset_id, sector and figures. The best of a sector are ranked once, so a sector with many assets costs most
    rows for each of them, not pairs; ties go to the smaller asset_id, null sizes come last. Assets without sector are alone.
    """
    order = Window.partitionBy("sector").orderBy(F.desc_nulls_last(size), "asset_id")
    best = assets.filter("sector is not null").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most)
    targets = assets.filter("sector is not null").select(F.col("asset_id").alias("target"), "sector").join(best.select(F.col("asset_id").alias("target"), F.col("_place").alias("_own")), "target", "left")
    # Those before the target move down by one place.
    others = targets.join(best, "sector").filter("asset_id <> target")
    others = others.withColumn("position", F.col("_place") + (F.col("_own").isNull() | (F.col("_place") < F.col("_own"))).cast("int")).filter(F.col("position") <= most)
    first = assets.withColumns({"target": F.col("asset_id"), "position": F.lit(1)})
    columns = ["target", "position", *assets.columns]
    return first.select(columns).unionByName(others.select(columns))


def long_form(rows: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """asset_id, part, metric and value of the columns that have one."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.select("asset_id", F.lit(part).alias("part"), F.inline(pairs)).filter("value is not null")


def stance(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """asset_id, stance, conviction and parts: of signs (-1 to 1) of the four parts, weighted and renormalised over those there are.

    rows: asset_id, part, sign. bullish above 0.2, bearish below -0.2; conviction is the size of the mean by the share
    of the weight that has a sign.
    """
    w = F.lit(0.0)
    for p, x in weights.items():
        w = F.when(F.col("part") == p, x).otherwise(w)
    g = rows.filter("sign is not null").withColumn("w", w).groupBy("asset_id").agg(F.sum(F.col("w") * F.col("sign")).alias("s"), F.sum("w").alias("w"), F.count_distinct("part").cast("int").alias("parts"))
    mean = F.try_divide(F.col("s"), F.col("w"))
    word = F.when(mean > 0.2, "bullish").when(mean < -0.2, "bearish").otherwise("neutral")
    return g.select("asset_id", word.alias("stance"), (F.abs(mean) * F.col("w") / sum(weights.values())).alias("conviction"), "parts")


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))

"""Daily market series and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Warning and critical limits of each signal.
SIGNAL_LIMITS = {
    "price_change": (0.15, 0.30),
    "volume_ratio": (2.0, 5.0),
    "oi_change": (0.20, 0.50),
    "unlock_30d": (0.05, 0.20),
}
FUNDING_LIMIT = 0.0005
#: Last rank of each market tier.
TIERS = [("top100", 100), ("top500", 500), ("top1000", 1000)]


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01"))


def daily_last(quotes: DataFrame) -> DataFrame:
    """asset_id, trade_date, price (the last of the day) and volume (quotes of the day).

    quotes: quote_id, asset_id, ts, price. Partial maxima combine before the shuffle; ties go to the greater id.
    """
    last = F.max_by("price", F.struct("ts", "quote_id"))
    return quotes.groupBy("asset_id", F.to_date("ts").alias("trade_date")).agg(last.alias("price"), F.count("*").alias("volume"))


def returns(daily: DataFrame, column: str = "price", name: str = "ret") -> DataFrame:
    """Adds the simple return on the asset's previous row."""
    before = F.lag(column).over(Window.partitionBy("asset_id").orderBy("trade_date"))
    return daily.withColumn(name, F.try_divide(F.col(column), before) - 1)


def volume_ratio(daily: DataFrame, days: int = 7) -> DataFrame:
    """Adds the day's volume by the mean of the asset's rows in the days before: calendar days, gaps allowed."""
    w = Window.partitionBy("asset_id").orderBy(day_number(F.col("trade_date"))).rangeBetween(-days, -1)
    return daily.withColumn("volume_ratio", F.try_divide(F.col("volume").cast("double"), F.avg("volume").over(w)))


def asset_signals(features: DataFrame) -> DataFrame:
    """asset_id, trade_date, signal, severity and value of every limit that a row reaches.

    features: asset_id, trade_date and any of the signals' columns; nulls raise none. Funding is a warning
    beyond its limit on either side, the limit itself excluded.
    """
    cases = []
    for name, (warn, critical) in SIGNAL_LIMITS.items():
        if name in features.columns:
            x = F.col(name) if name in ("volume_ratio", "unlock_30d") else F.abs(name)
            severity = F.when(x >= critical, "critical").when(x >= warn, "warning")
            cases.append(F.struct(F.lit(name).alias("signal"), severity.alias("severity"), F.col(name).cast("double").alias("value")))
    if "funding" in features.columns:
        severity = F.when(F.abs("funding") > FUNDING_LIMIT, "warning")
        cases.append(F.struct(F.lit("funding").alias("signal"), severity.alias("severity"), F.col("funding").cast("double").alias("value")))
    rows = features.select("asset_id", "trade_date", F.explode(F.array(*cases)).alias("s"))
    return rows.select("asset_id", "trade_date", "s.*").filter("severity is not null")


def by_severity(signals: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return signals.orderBy(rank, "asset_id", "trade_date", "signal")


def event_windows(events: DataFrame, daily: DataFrame, days: int = 7) -> DataFrame:
    """Metrics of prices and volumes around each event (event_id, asset_id, event_date).

    The range join is an equi-join: an event is repeated for each day of its window, so it needs no nested
    loop. pre_return, post_return: between the window's ends and the event day; max_drawdown, max_rally: least
    and greatest close after the event on that of the event day; volume_surge: mean volume after by before.
    """
    near = events.withColumn("offset", F.explode(F.sequence(F.lit(-days), F.lit(days))))
    near = near.withColumn("trade_date", F.date_add("event_date", F.col("offset")))
    rows = near.join(daily.select("asset_id", "trade_date", "price", "volume"), ["asset_id", "trade_date"])
    at = lambda k: F.max(F.when(F.col("offset") == k, F.col("price")))
    after, before = F.when(F.col("offset") > 0, F.col("price")), F.col("offset") < 0
    g = rows.groupBy("event_id", "asset_id", "event_date").agg(
        at(0).alias("p0"), at(-days).alias("pre"), at(days).alias("post"), F.min(after).alias("low"), F.max(after).alias("high"),
        F.avg(F.when(F.col("offset") > 0, F.col("volume"))).alias("v1"), F.avg(F.when(before, F.col("volume"))).alias("v0"),
    )
    share = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return g.select(
        "event_id", "asset_id", "event_date", (share("p0", "pre") - 1).alias("pre_return"), (share("post", "p0") - 1).alias("post_return"),
        (share("low", "p0") - 1).alias("max_drawdown"), (share("high", "p0") - 1).alias("max_rally"), share("v1", "v0").alias("volume_surge"),
    )


def divergence(rows: DataFrame) -> DataFrame:
    """Adds direction, hits and severity where at least three conditions of a top or a bottom hold.

    Columns: sentiment, chg24, chg7, whale7, holders7, to_cex, cap; a null holds no condition.
    """
    true = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    col = F.col
    top = true(col("sentiment") > 65) + true(col("chg24") < 0.05) + true(col("chg7") < 0.10) + true(col("whale7") < -0.03) + true(col("to_cex") > 0.001 * col("cap"))
    bottom = true(col("sentiment") < 35) + true(col("chg24") > -0.05) + true(col("chg7") > -0.10) + true(col("whale7") > 0.03) + true(col("holders7") > 0.05)
    top = F.when(col("sentiment") > 65, top).otherwise(0)
    bottom = F.when(col("sentiment") < 35, bottom).otherwise(0)
    out = rows.withColumn("hits", F.greatest(top, bottom)).withColumn("direction", F.when(top >= bottom, "top").otherwise("bottom"))
    return out.filter("hits >= 3").withColumn("severity", F.when(col("hits") >= 4, "high").otherwise("medium"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the key's latest right row at or before its time.

    One shuffle by the key and one sort: the rows of both sides run in time order and a window carries the
    last right row on, so neither side is repeated. Right rows of equal time: the greatest values win.
    """
    carried = F.struct(*values)
    l = left.select(F.col(key), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_v"))
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), carried.alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", F.col("_row").isNotNull(), "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_row is not null").select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def tier(rank: Column) -> Column:
    """Market tier of a rank; other beyond the last and for null."""
    out = F.when(rank <= TIERS[0][1], TIERS[0][0])
    for name, last in TIERS[1:]:
        out = out.when(rank <= last, name)
    return out.otherwise("other")


def scale_100(x: Column, w) -> Column:
    """x by its least and greatest value over w, 0 to 100; 0 where all are equal."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * 100

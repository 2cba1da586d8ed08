"""Transfers, exchange flows, holders and derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least USD amounts of the transfer buckets.
BUCKETS = [(">1M", 1_000_000), ("100K-1M", 100_000), ("10K-100K", 10_000)]


def with_direction(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """One row for each exchange side of a transfer: direction in or out, and the exchange.

    wallets: address, exchange; a short fixed list of seed wallets.
    """
    w = F.broadcast(wallets)
    into = transfers.join(w.withColumnRenamed("address", "to_address"), "to_address").withColumn("direction", F.lit("in"))
    out = transfers.join(w.withColumnRenamed("address", "from_address"), "from_address").withColumn("direction", F.lit("out"))
    return into.unionByName(out)


def netflow(moves: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """Out less in over the last 24 hours and 7 days by keys; positive: coins leave the exchanges."""
    signed = F.when(F.col("direction") == "out", F.col("usd")).otherwise(-F.col("usd"))
    within = lambda days: F.col("ts") > as_of - F.expr(f"interval {days} days")
    recent = moves.filter(within(7) & (F.col("ts") <= as_of))
    return recent.groupBy(*keys).agg(
        F.sum(F.when(within(1), signed).otherwise(0.0)).alias("net_24h"), F.sum(signed).alias("net_7d"), F.count("*").alias("transfers")
    )


def bucket(usd: Column) -> Column:
    out = F.when(usd > BUCKETS[0][1], BUCKETS[0][0])
    for name, least in BUCKETS[1:]:
        out = out.when(usd >= least, name)
    return out.otherwise("<10K")


def whale_signal(rows: DataFrame) -> DataFrame:
    """Adds score (-100 to 100) and signal from whale7, whale30, net24, net7 (shares, 0.1 is full strength)."""
    part = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.col(c), F.lit(0.0)) / 0.1))
    score = 100 * (0.40 * part("whale7") + 0.20 * part("whale30") + 0.25 * part("net24") + 0.15 * part("net7"))
    signal = F.when(F.col("score") > 20, "accumulate").when(F.col("score") < -20, "reduce").otherwise("neutral")
    return rows.withColumn("score", score).withColumn("signal", signal)


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def concentration(holders: DataFrame, keys: list[str], tops: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """Share of the greatest holders in each group's total. holders: keys, address, balance.

    The total combines before the shuffle; only each task's greatest rows reach the ranking.
    """
    return _shares(holders, holders, keys, tops)


def concentration_of_moves(moves: DataFrame, keys: list[str], parts: int, tops: tuple[int, ...] = (10, 50, 100), deals: int = 8) -> DataFrame:
    """As concentration, of moves (keys, address, amount) whose sums by address are the balances; most pairs have few moves.

    A group's addresses are dealt by their hash over that many of the parts tasks, which sum and rank their own; only
    the greatest of each reach the ranking of the group, so it has a bounded number of rows for each.
    """
    rows = moves.withColumn("_deal", F.pmod(F.xxhash64("address"), F.lit(deals))).repartition(parts, *keys, "_deal")
    held = rows.groupBy(*keys, "_deal", "address").agg(F.sum("amount").alias("balance"))
    best = held.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_deal").orderBy(F.desc("balance"), "address")))
    best = best.filter(F.col("_place") <= max(tops)).select(*keys, "address", "balance").repartition(parts, *keys)
    return _shares(held, best, keys, tops)


def _shares(holders: DataFrame, best: DataFrame, keys: list[str], tops: tuple[int, ...]) -> DataFrame:
    """best: rows of holders, the greatest of each group among them."""
    w = Window.partitionBy(*keys).orderBy(F.desc("balance"), "address")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(tops))
    total = holders.groupBy(*keys).agg(F.sum("balance").alias("total"), F.count("*").alias("holders"))
    top = ranked.groupBy(*keys).agg(*[F.sum(F.when(F.col("rank") <= n, F.col("balance")).otherwise(0.0)).alias(f"s{n}") for n in tops])
    shares = [F.try_divide(F.col(f"s{n}"), F.col("total")).alias(f"top{n}_share") for n in tops]
    return total.join(top, keys).select(*keys, "holders", *shares)


def weighted_funding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Open interest and funding weighted by it; null without open interest. rows: keys, funding, oi."""
    return rows.groupBy(*keys).agg(
        F.sum("oi").alias("oi"), F.try_divide(F.sum(F.col("funding") * F.col("oi")), F.sum("oi")).alias("funding")
    )


def change_over(series: DataFrame, keys: list[str], day: str, value: str, days: int) -> Column:
    """Change on the latest row of the key from days ago or earlier, as a column expression."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -days)
    return F.try_divide(F.col(value), F.last(value).over(w)) - 1

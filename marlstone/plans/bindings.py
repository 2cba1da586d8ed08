"""The engine's relations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import market
from marlstone.sources.tables import table


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("asset_id"), "ts", F.col("value").alias("price"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return market.daily_last(quotes(spark, folder))


#: The same as SQL, for the equivalents of queries on daily prices.
DAILY = """
daily as (
  select user_id as asset_id, cast(ts as date) as trade_date, value as price, n as volume
  from (select *, row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as rn,
               count(*) over (partition by user_id, cast(ts as date)) as n from events) where rn = 1)"""
RETS = DAILY + """,
rets as (select *, price / nullif(lag(price) over (partition by asset_id order by trade_date), 0) - 1 as ret from daily)"""


def ranked(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds rank, from 1 by value, highest first, then key.

    Bands of values (a thousandth of a power of e each, so some ten thousand at most) are counted; a rank is the
    number of rows in the bands above and the place in the own band, so no task sees more than a band.
    """
    rows = rows.withColumn("_band", F.floor(F.log(F.greatest(value, F.lit(1e-9))) * 1000))
    above = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("_band").agg(F.count("*").alias("_n")).select("_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    place = F.row_number().over(Window.partitionBy("_band").orderBy(F.desc(value), key))
    return rows.join(bands, "_band").withColumn("rank", (F.col("_above") + place).cast("long")).drop("_band", "_above")


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """part as assets: rank by price, then key."""
    return ranked(table(spark, folder, "part"), "p_retailprice", "p_partkey").select(
        F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.col("p_type").alias("sector"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "rank",
    )


ASSETS = """
assets as (select p_partkey as asset_id, p_brand as symbol, p_name as name, p_type as sector, p_retailprice as price, p_size as size,
  row_number() over (order by p_retailprice desc, p_partkey) as rank from part)"""


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with orders: from a supplier to a customer, returned items the other way."""
    l, o = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    back = F.col("l_returnflag") == "R"
    s, c = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(back, c).otherwise(s).alias("from_address"), F.when(back, s).otherwise(c).alias("to_address"),
        F.col("l_extendedprice").alias("usd"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("asset_id"),
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("line"),
    )


TRANSFERS = """
transfers as (select case when l_returnflag = 'R' then 'c' || o_custkey else 's' || l_suppkey end as from_address,
  case when l_returnflag = 'R' then 's' || l_suppkey else 'c' || o_custkey end as to_address, l_extendedprice as usd, l_shipdate as ts,
  l_partkey as asset_id, l_orderkey as tx, l_linenumber as line from lineitem join orders on l_orderkey = o_orderkey)"""


def wallets(spark: SparkSession, folder: str, n: int = 16) -> DataFrame:
    """Sixteen seed wallets of four exchanges."""
    s = table(spark, folder, "supplier").filter(F.col("s_suppkey") <= n)
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("address"), F.concat(F.lit("ex"), (F.col("s_suppkey") % 4).cast("string")).alias("exchange"))


WALLETS = """
wallets as (select 's' || s_suppkey as address, 'ex' || (s_suppkey % 4) as exchange from supplier where s_suppkey <= 16)"""


def last_of(df: DataFrame, column: str):
    """The table's own latest time, as the point of view of a run."""
    return df.agg(F.max(column)).first()[0]


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")

"""Queries on transfers, holders and derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import flows
from marlstone.plans.bindings import TRANSFERS, WALLETS, last_of, transfers, wallets
from marlstone.plans.registry import query
from marlstone.sources.tables import table

FLOW = f"""{TRANSFERS}, {WALLETS}, moves as (
  select t.*, exchange, 'in' as direction from transfers t join wallets on to_address = address
  union all select t.*, exchange, 'out' from transfers t join wallets on from_address = address),
recent as (select *, case when direction = 'out' then usd else -usd end as s, (select max(l_shipdate) from lineitem) as as_of from moves),
last7 as (select * from recent where ts > as_of - interval 7 days)"""
NET = "round(sum(case when ts > as_of - interval 1 day then s else 0 end), 4) as net_24h, round(sum(s), 4) as net_7d, count(*) as transfers"


def net(spark, d, keys):
    t = transfers(spark, d)
    moves = flows.with_direction(t, wallets(spark, d))
    out = flows.netflow(moves, F.lit(last_of(table(spark, d, "lineitem"), "l_shipdate")), keys)
    return out.select(*keys, F.round("net_24h", 4).alias("net_24h"), F.round("net_7d", 4).alias("net_7d"), "transfers")


@query(f"with {FLOW} select asset_id, {NET} from last7 group by asset_id")
def cex_netflow(spark, d):
    return net(spark, d, ["asset_id"])


@query(f"with {FLOW} select exchange, {NET} from last7 group by exchange")
def cex_netflow_by_exchange(spark, d):
    return net(spark, d, ["exchange"])


@query(f"""with {TRANSFERS} select case when usd * 20 > 1000000 then '>1M' when usd * 20 >= 100000 then '100K-1M' when usd * 20 >= 10000 then '10K-100K' else '<10K' end as bucket,
left(from_address, 1) = 's' as out_of_cex, count(*) as n, round(sum(usd * 20), 2) as usd from transfers group by 1, 2""")
def transfer_buckets(spark, d):
    t = transfers(spark, d).withColumn("usd", F.col("usd") * 20)
    g = t.groupBy(flows.bucket(F.col("usd")).alias("bucket"), F.col("from_address").startswith("s").alias("out_of_cex"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("usd"), 2).alias("usd"))


@query(f"""with {TRANSFERS}, x as (select asset_id, max(ts) as last_ts, (asset_id % 21 - 10) / 100 as whale7, (asset_id % 31 - 15) / 100 as whale30,
  round(sum(case when left(from_address, 1) = 's' then usd else -usd end) / sum(usd), 9) as net7, (asset_id % 7 - 3) / 50 as net24 from transfers group by asset_id),
s as (select *, 100 * (0.40 * least(1.0, greatest(-1.0, whale7 / 0.1)) + 0.20 * least(1.0, greatest(-1.0, whale30 / 0.1)) + 0.25 * least(1.0, greatest(-1.0, net24 / 0.1)) + 0.15 * least(1.0, greatest(-1.0, net7 / 0.1))) as score from x)
select asset_id, round(score, 5) as score, case when score > 20 then 'accumulate' when score < -20 then 'reduce' else 'neutral' end as signal from s""")
def whale_signal(spark, d):
    signed = F.when(F.col("from_address").startswith("s"), F.col("usd")).otherwise(-F.col("usd"))
    rows = transfers(spark, d).groupBy("asset_id").agg(F.round(F.sum(signed) / F.sum("usd"), 9).alias("net7")).withColumns({
        "whale7": (F.col("asset_id") % 21 - 10) / 100, "whale30": (F.col("asset_id") % 31 - 15) / 100, "net24": (F.col("asset_id") % 7 - 3) / 50,
    })
    return flows.whale_signal(rows).select("asset_id", F.round("score", 5).alias("score"), "signal")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1""")
def transfer_dedup(spark, d):
    order = [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice"), F.asc("l_quantity")]
    rows = flows.keep_one(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""with h as (select c_nationkey, o_custkey, sum(o_totalprice) as b from orders join customer on o_custkey = c_custkey group by 1, 2),
r as (select *, row_number() over (partition by c_nationkey order by b desc, o_custkey) as rk from h)
select c_nationkey, count(*) as holders, round(sum(b) filter (rk <= 10) / sum(b), 8) as top10_share, round(sum(b) filter (rk <= 50) / sum(b), 8) as top50_share,
  round(sum(b) filter (rk <= 100) / sum(b), 8) as top100_share from r group by c_nationkey""")
def top_holder_concentration(spark, d):
    h = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("balance"))
    h = h.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = flows.concentration(h.select("c_nationkey", F.col("o_custkey").alias("address"), "balance"), ["c_nationkey"])
    return out.select("c_nationkey", "holders", *[F.round(c, 8).alias(c) for c in out.columns[2:]])


@query("select l_partkey as asset_id, round(sum(l_quantity), 4) as oi, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) as funding from lineitem group by 1")
def funding_oi_weighted(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("asset_id"), F.col("l_discount").alias("funding"), F.col("l_quantity").alias("oi"))
    return flows.weighted_funding(rows, ["asset_id"]).select("asset_id", F.round("oi", 4).alias("oi"), F.round("funding", 8).alias("funding"))


@query("select l_partkey as asset_id, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as cvd from lineitem group by 1")
def cvd_netflow(spark, d):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("asset_id")).agg(F.sum(signed).alias("cvd"))


@query("""with x as (select l_suppkey as exchange, cast(l_shipdate as date) as day, sum(l_quantity) as oi from lineitem group by 1, 2)
select exchange, day, oi, round(oi / nullif(last_value(oi) over (partition by exchange order by day range between unbounded preceding and interval 7 day preceding), 0) - 1, 8) as change_7d from x""", date="day")
def oi_change_7d(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("exchange"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("oi"))
    return rows.withColumn("change_7d", F.round(flows.change_over(rows, ["exchange"], "day", "oi", 7), 8))


@query("""with x as (select o_custkey % 5 as chain, cast(o_orderdate as date) as snapshot_date, count(distinct o_custkey) as holders, sum(o_totalprice) as whale from orders group by 1, 2)
select chain, snapshot_date, holders, round(whale / nullif(last_value(whale) over (partition by chain order by snapshot_date range between unbounded preceding and interval 7 day preceding), 0) - 1, 8) as whale_7d,
round(whale / nullif(last_value(whale) over (partition by chain order by snapshot_date range between unbounded preceding and interval 30 day preceding), 0) - 1, 8) as whale_30d from x""", date="snapshot_date")
def holder_trend(spark, d):
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("chain"), F.to_date("o_orderdate").alias("snapshot_date"))
    rows = rows.agg(F.count_distinct("o_custkey").alias("holders"), F.sum("o_totalprice").alias("whale"))
    change = lambda n: F.round(flows.change_over(rows, ["chain"], "snapshot_date", "whale", n), 8)
    return rows.select("chain", "snapshot_date", "holders", change(7).alias("whale_7d"), change(30).alias("whale_30d"))


@query(f"""with {TRANSFERS}, t as (select tx, line, asset_id, usd * 2 as usd from transfers where usd * 2 >= 100000 and asset_id % 3 = 0)
select tx, line, max(usd) as usd from t group by tx, line""")
def meme_whale_alerts(spark, d):
    t = transfers(spark, d).withColumn("usd", F.col("usd") * 2).filter((F.col("usd") >= 100_000) & (F.col("asset_id") % 3 == 0))
    return flows.keep_one(t, ["tx", "line"], [F.desc("usd")]).select("tx", "line", "usd")


@query(f"with {TRANSFERS} select tx, line, from_address, to_address, usd from transfers order by usd desc, tx, line, from_address limit 20")
def top_transfers(spark, d):
    return transfers(spark, d).orderBy(F.desc("usd"), "tx", "line", "from_address").limit(20).select("tx", "line", "from_address", "to_address", "usd")

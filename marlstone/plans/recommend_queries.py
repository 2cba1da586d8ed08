"""From daily prices to recommendations, their archive and its backtest; assets of several sources; aggregates kept by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import partials, recommend, unify
from marlstone.plans.bindings import DAILY, daily, quotes
from marlstone.plans.entity_queries import FIGURES, WEIGHTS
from marlstone.plans.registry import query
from marlstone.plans.stream_queries import as_quotes, in_time
from marlstone.sources.tables import table
from marlstone.storage import new_path

RECS = f"""{DAILY}, wt(sector, w1, w2, w3, w4, w5) as (select * from {WEIGHTS}),
flow as (select user_id as asset_id, cast(ts as date) as trade_date, count(*) filter (event_type = 'purchase') as buys, count(*) filter (event_type = 'error') as sells from events group by 1, 2),
f as (select *, price / nullif(lag(price) over a, 0) - 1 as change, sum(volume) over w as v7, price / nullif(first_value(price) over w, 0) - 1 as momentum, sum(buys) over w as b7, sum(sells) over w as s7
  from daily join flow using (asset_id, trade_date) window a as (partition by asset_id order by trade_date), w as (partition by asset_id order by trade_date range between interval 6 day preceding and current row)),
s as (select f.*, p_brand as symbol, split_part(p_name, ' ', 2) as chain, p_type as sector, case when asset_id in (select o_custkey from orders where o_orderstatus = 'F') then '2/3' else '1/3' end as consensus,
  round(coalesce(w1, 0.2) * least(100.0, v7 * 2.0) + coalesce(w2, 0.2) * (50 + 50 * greatest(-1.0, least(1.0, coalesce(momentum, 0)))) + coalesce(w3, 0.2) * coalesce(100.0 * b7 / nullif(b7 + s7, 0), 50.0)
    + coalesce(w4, 0.2) * (50 + 50 * greatest(-1.0, least(1.0, coalesce(change, 0)))) + coalesce(w5, 0.2) * least(100.0, volume * 10.0), 6) as score
  from f join part on p_partkey = asset_id left join wt on wt.sector = p_type),
t as (select * from s qualify row_number() over (partition by trade_date order by score desc, asset_id) <= 10),
recs as (select trade_date as rec_date, symbol, chain, asset_id, sector, price, score, consensus from t qualify row_number() over (partition by trade_date, symbol, chain order by score desc, asset_id) = 1)"""


def scores_by_day(spark, d):
    """Every asset's score on every day, with its symbol, chain, sector and whether a second source has it."""
    e = table(spark, d, "events")
    flow = e.groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("trade_date")).agg(F.count_if(F.col("event_type") == "purchase").alias("buys"), F.count_if(F.col("event_type") == "error").alias("sells"))
    rows = recommend.features(daily(spark, d).join(flow, ["asset_id", "trade_date"]))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("symbol"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("chain"), F.col("p_type").alias("sector"))
    other = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("asset_id")).distinct().withColumn("both", F.lit(True))
    rows = rows.join(p, "asset_id").join(other, "asset_id", "left").withColumn("consensus", F.when(F.col("both"), "2/3").otherwise("1/3"))
    return recommend.scored(rows, spark.sql(f"select sector, w1 as volume, w2 as momentum, w3 as buy_ratio, w4 as change, w5 as txns from {WEIGHTS}"))


def archived(spark, d):
    """The archive after three runs of ten days each, of which the second is started twice and the third looks back on the second's days."""
    best, kept = recommend.daily_best(scores_by_day(spark, d)), recommend.archive_table(spark, new_path(spark, "recommendations"), 4)
    first, last = table(spark, d, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    if first:
        day, third = F.datediff("rec_date", F.lit(first)), (last - first).days // 3 + 1
        for name, low, high in (("1", 0, third), ("2", third, 2 * third), ("2", third, 2 * third), ("3", third + third // 2, 3 * third)):
            recommend.archive(kept, best.filter((day >= low) & (day < high)), name)
    return kept.read()


@query(f"with {RECS} select rec_date, symbol, chain, asset_id, sector, price, score, consensus from recs", date="rec_date")
def recommendations_archived(spark, d):
    """Ten recommendations a day at most, by scores of what was known on that day, from the archive."""
    return archived(spark, d)


OUT = f"""{RECS}, o as (select recs.*, case when score >= 70 then '>=70' when score >= 50 then '50-70' else '<50' end as band, n.now / nullif(recs.price, 0) - 1 as held,
  d1.price / nullif(recs.price, 0) - 1 as ret_1, d3.price / nullif(recs.price, 0) - 1 as ret_3, d7.price / nullif(recs.price, 0) - 1 as ret_7
  from recs join (select asset_id, arg_max(price, trade_date) as now from daily group by 1) n using (asset_id) left join daily d1 on d1.asset_id = recs.asset_id and d1.trade_date = rec_date + 1
  left join daily d3 on d3.asset_id = recs.asset_id and d3.trade_date = rec_date + 3 left join daily d7 on d7.asset_id = recs.asset_id and d7.trade_date = rec_date + 7)"""


@query(f"""with {OUT}, b as (select *, held as ret from o)
select coalesce(band, 'all') as band, coalesce(sector, 'all') as sector, {FIGURES} from b group by grouping sets ((band), (sector), ())""")
def recommendation_backtest(spark, d):
    """Returns of the archived recommendations, from the archived price to the last, by band of score and by sector."""
    rows = recommend.outcomes(archived(spark, d), daily(spark, d))
    g = rows.groupingSets([[F.col("band")], [F.col("sector")], []], F.col("band"), F.col("sector")).agg(*recommend.figures(F.col("held")))
    return g.withColumns({"band": F.coalesce("band", F.lit("all")), "sector": F.coalesce("sector", F.lit("all"))})


@query(f"""with {OUT}, h as (select 1 as days, ret_1 as ret, consensus from o union all select 3, ret_3, consensus from o union all select 7, ret_7, consensus from o)
select days, consensus, {FIGURES.replace("count(*) as n", "count(ret) as n")} from h group by 1, 2""")
def recommendation_horizons(spark, d):
    """Returns one, three and seven days after the recommendation, by consensus."""
    rows = recommend.outcomes(archived(spark, d), daily(spark, d))
    rows = rows.selectExpr("consensus", "stack(3, 1, ret_1, 3, ret_3, 7, ret_7) as (days, ret)")
    return rows.groupBy("days", "consensus").agg(*recommend.figures(F.col("ret")))


ORDER = ["cmc", "cg", "dl"]
SOURCES = """
src as (select 'cmc' as source, p_partkey::varchar as id, upper(p_name || '/' || p_brand) as symbol, '0x' || md5(p_name || p_size) as contract, p_name as name, p_retailprice as price from part where p_size <= 40
  union select 'cg', l_suppkey::varchar, upper(s_name), '0x' || md5(p_name || p_size), s_name, s_acctbal from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_returnflag = 'R' and l_discount >= 0.095 and l_tax >= 0.075
  union select 'dl', p_partkey::varchar, upper(p_name || '/' || p_brand), null, null, p_retailprice from part where p_size > 40),
rk as (select *, case source when 'cmc' then 1 when 'cg' then 2 else 3 end as rank, source || ':' || id as node from src)"""
ASSET = f"""{SOURCES}, e as (select distinct node as u, contract as v from rk where contract is not null), ee as (select u, v from e union select v, u from e),
reach(a, b) as (select u, u from ee union select a, v from reach join ee on b = u),
cc as (select a as node, min(b) as component from reach where not starts_with(a, '0x') group by 1),
w as (select distinct rk.node, source, id, symbol, rank, component from rk join cc using (node) where contract is not null),
own as (select symbol, min(component) as one, max(component) as other from w where symbol <> '' group by 1),
wo as (select distinct node, source, id, rk.symbol, rank, case when one = other then one when one is not null then node else 's|' || rk.symbol end as component, case when one <> other then 'ambiguous' else 'symbol' end as how
  from rk left join own on own.symbol = rk.symbol where node not in (select node from w)),
al as (select node, source, id, rank, component, 'contract' as how from w union all select node, source, id, rank, component, how from wo),
nm as (select component, min((rank, source, id)) as f, count(distinct node) as n from al group by 1),
un as (select source, id, f[2] || ':' || f[3] as asset, case when n = 1 and how <> 'ambiguous' then 'alone' else how end as matched_by from al join nm using (component))"""


def source_rows(spark, d):
    """Three sources: parts with a contract, suppliers with the contracts of some parts that came back, parts without a contract."""
    p = table(spark, d, "part")
    contract, symbol = F.concat(F.lit("0X"), F.upper(F.md5(F.concat("p_name", F.col("p_size").cast("string"))))), F.concat_ws("/", "p_name", "p_brand")
    cmc = p.filter("p_size <= 40").select(F.lit("cmc").alias("source"), F.col("p_partkey").cast("string").alias("id"), symbol.alias("symbol"), contract.alias("contract"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount >= 0.095D and l_tax >= 0.075D").select("l_suppkey", "l_partkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    cg = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("cg"), F.col("l_suppkey").cast("string"), "s_name", F.lower(contract), "s_name", "s_acctbal"
    ).distinct()
    dl = p.filter("p_size > 40").select(F.lit("dl"), F.col("p_partkey").cast("string"), F.lower(symbol), F.lit(None).cast("string"), F.lit(None).cast("string"), "p_retailprice")
    return cmc.union(cg).union(dl)


@query(f"with recursive {ASSET} select * from un")
def unified_assets(spark, d):
    """Which asset each row of three sources is of."""
    return unify.members(source_rows(spark, d), ORDER)


@query(f"""with recursive {ASSET}, g as (select asset, name, price, source, rank, rk.id from rk join un using (source, id))
select asset, arg_min(name, (rank, source, id, name)) filter (name is not null) as name, arg_min(source, (rank, source, id, name)) filter (name is not null) as name_source,
  arg_min(price, (rank, source, id, price)) filter (price is not null) as price, arg_min(source, (rank, source, id, price)) filter (price is not null) as price_source from g group by 1""")
def golden_assets(spark, d):
    """One row for each asset: every field with the source that it is from."""
    rows = source_rows(spark, d)
    return unify.golden(rows, unify.members(rows, ORDER), ORDER, ["name", "price"])


@query("""select user_id as asset_id, cast(ts as date) as trade_date, arg_max(value, (ts, event_id)) as price, count(*) as volume, round(avg(value), 6) as mean, round(stddev_pop(value), 5) as deviation, min(value) as low, max(value) as high
from events group by 1, 2""", date="trade_date")
def daily_kept(spark, d):
    """Figures of a day from states that three batches added to, the second of which ran twice."""
    kept = partials.Kept(partials.state_table(spark, new_path(spark, "daily-states"), 8))
    rows, bounds = quotes(spark, d), table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    if bounds[0]:
        step = (bounds[1] - bounds[0]) / 3
        cut = [bounds[0] + step * 1.4, bounds[0] + step * 2.1]
        for number, part in ((0, F.col("ts") < cut[0]), (1, (F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), (1, (F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), (2, F.col("ts") >= cut[1])):
            kept(rows.filter(part), number)
    out = partials.daily_figures(kept.table.read())
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 5)})


@query("""select user_id as asset_id, cast(date_trunc('week', ts) as date) as week, arg_max(value, (ts, event_id)) as price, count(*) as volume, min(value) as low, max(value) as high from events group by 1, 2""", date="week")
def weekly_kept(spark, d):
    """Weeks from the days' states, which a stream of landed files has kept."""
    kept = partials.Kept(partials.state_table(spark, new_path(spark, "weekly-states"), 8))
    in_time(spark, d, 3, None, as_quotes, kept)
    return partials.weekly_figures(kept.table.read()).drop("mean", "deviation")

"""Derivatives, competitors over six tables, and what a thesis in four parts starts from; signals on inputs that the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import derivatives, flows, market, selection
from marlstone.operators.skew import tasks_for
from marlstone.plans.bindings import RETS, TRANSFERS, WALLETS, daily, last_of, transfers, wallets
from marlstone.plans.market_queries import VOLUME
from marlstone.plans.registry import query
from marlstone.plans.research_queries import SOCIAL, social
from marlstone.sources.tables import table

#: A supplier stands for an asset, a line's number for an exchange, its quantity for open interest.
DERIV = """
dx as (select l_suppkey as asset_id, l_linenumber as exchange, cast(l_shipdate as date) as day, l_quantity as oi, l_discount - 0.05 as funding,
  case when l_returnflag = 'R' then 0 else l_quantity end as b, case when l_returnflag = 'R' then l_quantity else 0 end as s from lineitem),
dd as (select asset_id, day, count(distinct exchange) as exchanges, sum(oi) as oi, sum(funding * oi) / nullif(sum(oi), 0) as funding, sum(b) as buys, sum(s) as sells from dx group by 1, 2),
dh as (select *, oi / nullif(last_value(oi) over (o range between unbounded preceding and interval 1 day preceding), 0) - 1 as oi_change_24h,
  oi / nullif(last_value(oi) over (o range between unbounded preceding and interval 7 day preceding), 0) - 1 as oi_change_7d,
  oi / nullif(last_value(oi) over (o range between unbounded preceding and interval 30 day preceding), 0) - 1 as oi_change_30d,
  avg(funding) over (o range between interval 6 day preceding and current row) as funding_7d, avg(funding) over (o range between interval 29 day preceding and current row) as funding_30d,
  sum(buys) over (o range between interval 29 day preceding and current row) as b30, sum(sells) over (o range between interval 29 day preceding and current row) as s30
  from dd window o as (partition by asset_id order by day)),
da as (select asset_id, day, exchanges, oi, funding, funding_7d, funding_30d, oi_change_24h, oi_change_7d, b30 - s30 as cvd, b30 / nullif(s30, 0) as long_short from dh qualify row_number() over (partition by asset_id order by day desc) = 1)"""
R6 = ", ".join(f"round({m}, 9) as {m}" for m in derivatives.METRICS)


def deriv_days(spark, d):
    back = F.col("l_returnflag") == "R"
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"), F.col("l_linenumber").alias("exchange"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("oi"), (F.col("l_discount") - 0.05).alias("funding"),
        F.when(back, 0.0).otherwise(F.col("l_quantity")).alias("taker_buy"), F.when(back, F.col("l_quantity")).otherwise(0.0).alias("taker_sell"),
    )
    return derivatives.by_day(rows, tasks_for(rows))


def rounded(rows, columns, n=9):
    return rows.withColumns({c: F.round(c, n) for c in columns})


@query(f"with {DERIV} select asset_id, day, exchanges, {R6} from da", date="day")
def asset_derivatives(spark, d):
    """The eight derivative metrics of each asset as one row."""
    return rounded(derivatives.answer(deriv_days(spark, d)), derivatives.METRICS)


HISTORY = ("oi", "funding", "funding_7d", "funding_30d", "oi_change_24h", "oi_change_7d", "oi_change_30d")


@query(f"with {DERIV} select asset_id, day, exchanges, {', '.join(f'round({c}, 9) as {c}' for c in HISTORY)} from dh", date="day")
def derivatives_history(spark, d):
    """Open interest over all exchanges with its changes, and funding with its means, for every asset and day."""
    return rounded(derivatives.history(deriv_days(spark, d)), HISTORY).select("asset_id", "day", "exchanges", *HISTORY)


#: Six tables of a supplier as an asset: market, derivatives, holders, social heat, unlocks, materials.
SIX = f"""{DERIV}, {SOCIAL},
base as (select s_suppkey as asset_id, s_nationkey as sector, s_name as name from supplier),
t1 as (select l_suppkey as asset_id, round(sum(l_extendedprice), 2) as volume, round(arg_max(l_extendedprice / nullif(l_quantity, 0), (l_shipdate, l_orderkey, l_linenumber)), 9) as price from lineitem group by 1),
t2 as (select asset_id, round(oi, 9) as oi, round(funding, 9) as funding from da),
h as (select l_suppkey as asset_id, o_custkey, sum(l_quantity) as b from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
t3 as (select asset_id, count(*) as holders, round(sum(b) filter (rk <= 10) / nullif(sum(b), 0), 9) as top10_share from (select *, row_number() over (partition by asset_id order by b desc, o_custkey) as rk from h) group by 1),
t4 as (select asset_id, round(score, 6) as heat from t),
t5 as (select o_custkey as asset_id, round(sum(o_totalprice) filter (o_orderdate > (select max(o_orderdate) from orders) - interval 180 day) / nullif(sum(o_totalprice), 0), 6) as unlocking from orders group by 1),
t6 as (select doc_id % (select greatest(count(*), 1) from supplier) as asset_id, count(*) as documents from documents group by 1),
six as (select b.*, volume, price, oi, funding, holders, top10_share, heat, unlocking, documents, (t1.asset_id is not null)::int + (t2.asset_id is not null)::int + (t3.asset_id is not null)::int + (t4.asset_id is not null)::int + (t5.asset_id is not null)::int + (t6.asset_id is not null)::int as have
  from base b left join t1 using (asset_id) left join t2 using (asset_id) left join t3 using (asset_id) left join t4 using (asset_id) left join t5 using (asset_id) left join t6 using (asset_id))"""
FIGURES = ["volume", "price", "oi", "funding", "holders", "top10_share", "heat", "unlocking", "documents"]


def six_tables(spark, d):
    l, o, s = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "supplier")
    asset = F.col("l_suppkey").alias("asset_id")
    price = F.max_by(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")), F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    parts = tasks_for(l)
    held = l.select("l_orderkey", asset, F.col("l_quantity").alias("amount")).repartition(parts, "l_orderkey").join(o.select("o_orderkey", F.col("o_custkey").alias("address")), F.col("l_orderkey") == F.col("o_orderkey"))
    holders = flows.concentration_of_moves(held.select("asset_id", "address", "amount"), ["asset_id"], parts, (10,))
    recent = F.col("o_orderdate") > F.lit(last_of(o, "o_orderdate")).cast(o.schema["o_orderdate"].dataType) - F.expr("interval 180 days")
    figures = {
        "market": l.groupBy(asset).agg(F.round(F.sum("l_extendedprice"), 2).alias("volume"), F.round(price, 9).alias("price")),
        "derivatives": rounded(derivatives.answer(deriv_days(spark, d)), ["oi", "funding"]).select("asset_id", "oi", "funding"),
        "holders": rounded(holders, ["top10_share"]),
        "heat": social(spark, d).select("asset_id", F.round("score", 6).alias("heat")),
        "unlocks": o.groupBy(F.col("o_custkey").alias("asset_id")).agg(F.round(F.try_divide(F.sum(F.when(recent, F.col("o_totalprice"))), F.sum("o_totalprice")), 6).alias("unlocking")),
        "documents": table(spark, d, "documents").groupBy((F.col("doc_id") % max(s.count(), 1)).alias("asset_id")).agg(F.count("*").alias("documents")),
    }
    base = s.select(F.col("s_suppkey").alias("asset_id"), F.col("s_nationkey").alias("sector"), F.col("s_name").alias("name"))
    return derivatives.gathered(base, figures)


@query(f"""with {SIX}, b as (select *, row_number() over (partition by sector order by volume desc nulls last, asset_id) as place from six where sector is not null)
select t.asset_id as target, row_number() over (partition by t.asset_id order by c.asset_id = t.asset_id desc, c.place) as position, c.asset_id, c.name, c.{", c.".join(FIGURES)}, c.have
from six t join b c on c.sector = t.sector qualify position <= 10""")
def competitor_metrics(spark, d):
    """Every asset with the nine greatest of its sector, the figures of six tables beside each."""
    return derivatives.competitors(six_tables(spark, d), "volume").withColumn("position", F.col("position").cast("long")).drop("sector")


PARTS = {"valuation": 0.25, "chips": 0.30, "sentiment": 0.20, "catalyst": 0.25}
CLIP = "greatest(-1.0, least(1.0, {}))"
THESIS = f"""{SIX}, md as (select sector, median(volume) as mid from six group by 1),
sg as (select asset_id, 'valuation' as part, {CLIP.format("log2(mid / nullif(volume, 0))")} as sign from six join md using (sector) union all select asset_id, 'chips', {CLIP.format("(cvd / nullif(oi, 0)) / 10")} from da
  union all select asset_id, 'sentiment', {CLIP.format("(heat - 50) / 50")} from six union all select asset_id, 'catalyst', {CLIP.format("1 - 4 * unlocking")} from six)"""


def signs(spark, d):
    """One sign for each part: cheap by volume within the sector, bought more than sold, well spoken of, little to unlock."""
    six = six_tables(spark, d)
    mid = six.groupBy("sector").agg(F.median("volume").alias("mid"))
    own = derivatives.answer(deriv_days(spark, d))
    sign = lambda rows, part, x: rows.select("asset_id", F.lit(part).alias("part"), derivatives.clipped(x).alias("sign"))
    out = sign(six.join(mid, "sector"), "valuation", F.log2(F.try_divide(F.col("mid"), F.col("volume"))))
    out = out.unionByName(sign(own, "chips", F.try_divide(F.col("cvd"), F.col("oi")) / 10))
    return out.unionByName(sign(six, "sentiment", (F.col("heat") - 50) / 50)).unionByName(sign(six, "catalyst", 1 - 4 * F.col("unlocking")))


@query(f"""with {THESIS}, wt(part, w) as (values {", ".join(f"('{k}', {v})" for k, v in PARTS.items())}),
g as (select asset_id, sum(w * sign) / sum(w) as m, sum(w) as w, count(distinct part)::int as parts from sg join wt using (part) where sign is not null group by 1)
select asset_id, case when m > 0.2 then 'bullish' when m < -0.2 then 'bearish' else 'neutral' end as stance, round(abs(m) * w, 5) as conviction, parts from g""")
def thesis_stance(spark, d):
    """Stance and conviction of each asset from the four parts."""
    return rounded(derivatives.stance(signs(spark, d), PARTS), ["conviction"], 5)


_LONG = lambda part, columns, source: " union all ".join(f"select asset_id, '{part}' as part, '{c}' as metric, {c}::double as value from {source}" for c in columns)


@query(f"""with {THESIS}, x as ({_LONG("valuation", ["price", "volume"], "six")} union all {_LONG("chips", ["holders", "top10_share"], "six")} union all {_LONG("chips", derivatives.METRICS, "da")}
  union all {_LONG("sentiment", ["heat"], "six")} union all {_LONG("catalyst", ["unlocking", "documents"], "six")})
select asset_id, part, metric, round(value, 9) as value from x where value is not null""")
def thesis_facts(spark, d):
    """Every figure of the four parts, the eight derivative metrics among them: what a thesis may say."""
    return facts(spark, d)


def facts(spark, d):
    six = six_tables(spark, d)
    parts = [(six, "valuation", ["price", "volume"]), (six, "chips", ["holders", "top10_share"]), (derivatives.answer(deriv_days(spark, d)), "chips", list(derivatives.METRICS)), (six, "sentiment", ["heat"]), (six, "catalyst", ["unlocking", "documents"])]
    rows = [derivatives.long_form(*p) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("value", F.round("value", 9))


@query(f"""with {THESIS}, wt(part, w) as (values {", ".join(f"('{k}', {v})" for k, v in PARTS.items())}),
g as (select asset_id, sum(w * sign) / sum(w) as m from sg join wt using (part) where sign is not null group by 1)
select asset_id, unnest([1, 2]) as version, case when m > 0.2 then 'bullish' when m < -0.2 then 'bearish' else 'neutral' end as stance from g""")
def thesis_versions(spark, d):
    """Each run adds a version, and the earlier ones stay: two runs on the same facts."""
    new = derivatives.stance(signs(spark, d), PARTS).select("asset_id", "stance")
    none = spark.createDataFrame([], "asset_id long, stance string, version int").select("asset_id", "stance", "version")
    once = selection.append_version(none, new.withColumn("version", F.lit(None).cast("int")), "asset_id")
    return selection.append_version(once, new.withColumn("version", F.lit(None).cast("int")), "asset_id").select("asset_id", "version", "stance")


#: Signals of a day from what events and orders hold: no figure is made of an id.
INPUTS = f"""{RETS}, {VOLUME},
ev as (select user_id as asset_id, cast(ts as date) as trade_date, count(*) as n, count(*) filter (event_type = 'purchase') as buys, count(*) filter (event_type = 'error') as sells, count(*) filter (event_type = 'signup') as joined,
  sum(value) filter (event_type = 'error') as to_cex, sum(value) filter (event_type = 'purchase') as whale, avg(value) filter (event_type = 'view') as sentiment from events group by 1, 2),
un as (select o_custkey as asset_id, sum(o_totalprice) filter (o_orderdate > (select max(o_orderdate) from orders) - interval 180 day) / nullif(sum(o_totalprice), 0) as unlock_30d from orders group by 1),
fe as (select v.asset_id, v.trade_date, ret as price_change, volume_ratio, v.volume / nullif(lag(v.volume) over (partition by v.asset_id order by v.trade_date), 0) - 1 as oi_change, (buys - sells) / n / 1000.0 as funding, coalesce(unlock_30d, 0) as unlock_30d
  from vol v join ev using (asset_id, trade_date) left join un using (asset_id))"""


def day_events(spark, d):
    kind = lambda k: F.col("event_type") == k
    value = lambda k: F.when(kind(k), F.col("value"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("trade_date")).agg(
        F.count("*").alias("n"), F.count_if(kind("purchase")).alias("buys"), F.count_if(kind("error")).alias("sells"), F.count_if(kind("signup")).alias("joined"),
        F.sum(value("error")).alias("to_cex"), F.sum(value("purchase")).alias("whale"), F.avg(value("view")).alias("sentiment"),
    )


def unlock_share(spark, d):
    o = table(spark, d, "orders")
    recent = F.col("o_orderdate") > F.lit(last_of(o, "o_orderdate")).cast(o.schema["o_orderdate"].dataType) - F.expr("interval 180 days")
    return o.groupBy(F.col("o_custkey").alias("asset_id")).agg(F.try_divide(F.sum(F.when(recent, F.col("o_totalprice"))), F.sum("o_totalprice")).alias("unlock_30d"))


@query(f"""with {INPUTS}, s as (select asset_id, trade_date, 'price_change' as signal, case when abs(price_change) >= 0.30 then 'critical' when abs(price_change) >= 0.15 then 'warning' end as severity, price_change as value from fe
  union all select asset_id, trade_date, 'volume_ratio', case when volume_ratio >= 5 then 'critical' when volume_ratio >= 2 then 'warning' end, volume_ratio from fe
  union all select asset_id, trade_date, 'oi_change', case when abs(oi_change) >= 0.50 then 'critical' when abs(oi_change) >= 0.20 then 'warning' end, oi_change from fe
  union all select asset_id, trade_date, 'unlock_30d', case when unlock_30d >= 0.20 then 'critical' when unlock_30d >= 0.05 then 'warning' end, unlock_30d from fe
  union all select asset_id, trade_date, 'funding', case when abs(funding) > 0.0005 then 'warning' end, funding from fe)
select asset_id, trade_date, signal, severity, round(value, 8) as value from s where severity is not null""", date="trade_date")
def signals_from_tables(spark, d):
    rows = market.returns(market.volume_ratio(market.returns(daily(spark, d))), "volume", "oi_change").join(day_events(spark, d), ["asset_id", "trade_date"]).join(unlock_share(spark, d), "asset_id", "left")
    rows = rows.select("asset_id", "trade_date", F.col("ret").alias("price_change"), "volume_ratio", "oi_change", ((F.col("buys") - F.col("sells")) / F.col("n") / 1000.0).alias("funding"), F.coalesce("unlock_30d", F.lit(0.0)).alias("unlock_30d"))
    return market.asset_signals(rows).withColumn("value", F.round("value", 8))


@query(f"""with {INPUTS}, x as (select v.asset_id, trade_date, ret as chg24, sentiment, coalesce(to_cex, 0) as to_cex, v.price / nullif(first_value(v.price) over w8, 0) - 1 as chg7,
  sum(whale) over w7 / nullif(sum(whale) over p7, 0) - 1 as whale7, sum(joined) over w7 / nullif(sum(joined) over p7, 0) - 1 as holders7, sum(v.price * v.volume) over w7 as cap from vol v join ev using (asset_id, trade_date)
  window w8 as (partition by v.asset_id order by trade_date range between interval 7 day preceding and current row), w7 as (partition by v.asset_id order by trade_date range between interval 6 day preceding and current row),
    p7 as (partition by v.asset_id order by trade_date range between interval 13 day preceding and interval 7 day preceding)),
h as (select *, coalesce(cast(chg24 < 0.05 as int), 0) + coalesce(cast(chg7 < 0.10 as int), 0) + coalesce(cast(whale7 < -0.03 as int), 0) + coalesce(cast(to_cex > 0.001 * cap as int), 0) as t,
  coalesce(cast(chg24 > -0.05 as int), 0) + coalesce(cast(chg7 > -0.10 as int), 0) + coalesce(cast(whale7 > 0.03 as int), 0) + coalesce(cast(holders7 > 0.05 as int), 0) as b from x)
select asset_id, trade_date, case when sentiment > 65 then 'top' else 'bottom' end as direction, 1 + case when sentiment > 65 then t else b end as hits, case when 1 + case when sentiment > 65 then t else b end >= 4 then 'high' else 'medium' end as severity
from h where (sentiment > 65 and t >= 2) or (sentiment < 35 and b >= 2)""", date="trade_date")
def divergence_from_tables(spark, d):
    """Tops and bottoms of sentiment against prices, large buyers, new holders and what moves to exchanges."""
    rows = market.returns(daily(spark, d), name="chg24").join(day_events(spark, d), ["asset_id", "trade_date"])
    order = Window.partitionBy("asset_id").orderBy(market.day_number(F.col("trade_date")))
    week, before = order.rangeBetween(-6, 0), order.rangeBetween(-13, -7)
    change = lambda c: F.try_divide(F.sum(c).over(week), F.sum(c).over(before)) - 1
    rows = rows.withColumns({
        "chg7": F.try_divide(F.col("price"), F.first("price").over(order.rangeBetween(-7, 0))) - 1, "whale7": change("whale"), "holders7": change("joined"),
        "to_cex": F.coalesce("to_cex", F.lit(0.0)), "cap": F.sum(F.col("price") * F.col("volume")).over(week),
    })
    return market.divergence(rows).select("asset_id", "trade_date", "direction", "hits", "severity")


@query(f"""with {TRANSFERS}, {WALLETS}, z as (select max(ts) as t from transfers),
g as (select asset_id, sum(usd) as total, sum(case when ts > t - interval 7 day and usd >= 50000 then (case when starts_with(from_address, 's') then usd else -usd end) else 0 end) as w7,
  sum(case when ts > t - interval 30 day and usd >= 50000 then (case when starts_with(from_address, 's') then usd else -usd end) else 0 end) as w30,
  sum(case when ts > t - interval 1 day then (case when f.address is not null then usd else 0 end) - (case when i.address is not null then usd else 0 end) else 0 end) as n1,
  sum(case when ts > t - interval 7 day then (case when f.address is not null then usd else 0 end) - (case when i.address is not null then usd else 0 end) else 0 end) as n7
  from transfers join z on true left join wallets f on f.address = from_address left join wallets i on i.address = to_address group by 1),
s as (select asset_id, 100 * (0.40 * {CLIP.format("w7 / total / 0.1")} + 0.20 * {CLIP.format("w30 / total / 0.1")} + 0.25 * {CLIP.format("n1 / total / 0.1")} + 0.15 * {CLIP.format("n7 / total / 0.1")}) as score from g)
select asset_id, round(score, 5) as score, case when score > 20 then 'accumulate' when score < -20 then 'reduce' else 'neutral' end as signal from s""")
def whale_from_tables(spark, d):
    """What large transfers and exchanges' wallets did in the last day, week and month, by an asset's whole volume."""
    t = transfers(spark, d)
    now = F.lit(last_of(table(spark, d, "lineitem"), "l_shipdate")).cast(t.schema["ts"].dataType)
    own = [r.address for r in wallets(spark, d).collect()]  # a short fixed list of seed wallets
    within = lambda n: F.col("ts") > now - F.expr(f"interval {n} days")
    large = F.when(F.col("usd") >= 50_000, F.when(F.col("from_address").startswith("s"), F.col("usd")).otherwise(-F.col("usd"))).otherwise(0.0)
    side = lambda c: F.when(F.col(c).isin(own), F.col("usd")).otherwise(0.0)
    net = side("from_address") - side("to_address")
    part = lambda x, n: F.sum(F.when(within(n), x).otherwise(0.0)) / F.sum("usd")
    rows = t.groupBy("asset_id").agg(part(large, 7).alias("whale7"), part(large, 30).alias("whale30"), part(net, 1).alias("net24"), part(net, 7).alias("net7"))
    return flows.whale_signal(rows).select("asset_id", F.round("score", 5).alias("score"), "signal")

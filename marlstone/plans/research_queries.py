"""Queries on documents, materials, watch lists and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import entities, research
from marlstone.plans.bindings import last_of
from marlstone.plans.registry import query
from marlstone.sources.tables import table

KINDS = ["whitepaper", "docs", "site", "github", "blog", "audit", "other"]
KIND = "(['" + "', '".join(KINDS) + "'])[doc_id % 7 + 1]"


@query(f"""with x as (select doc_id % 20 as asset_id, {KIND} as kind, doc_id as link_id, n_chars as rank from documents),
q as (select *, row_number() over (partition by asset_id, kind order by rank, link_id) <= (case kind when 'whitepaper' then 3 when 'docs' then 5 when 'site' then 3 when 'github' then 5 when 'blog' then 5 when 'audit' then 3 else 3 end) as in_quota from x)
select asset_id, link_id, kind, in_quota, row_number() over (partition by asset_id order by in_quota desc, rank, link_id) as place from q qualify place <= 50""")
def quota_topk(spark, d):
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 7).cast("int"))
    rows = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("asset_id"), kind.alias("kind"), F.col("doc_id").alias("link_id"), F.col("n_chars").alias("rank"))
    return research.curate(rows).select("asset_id", "link_id", "kind", "in_quota", "place")


MATERIALS = list(research.FILL_ACTIONS)
HAVE = f"""
a as (select distinct doc_id % 100 as asset_id from documents),
h as (select distinct doc_id % 100 as asset_id, (['{"', '".join(MATERIALS)}'])[(doc_id // 100) % 6 + 1] as material from documents where doc_id % 3 <> 0),
gap as (select asset_id, material from a, (select unnest(['{"', '".join(MATERIALS)}']) as material) where (asset_id, material) not in (select asset_id, material from h))"""


def gaps(spark, d):
    docs = table(spark, d, "documents")
    assets = docs.select((F.col("doc_id") % 100).alias("asset_id")).distinct()
    material = F.get(F.array(*map(F.lit, MATERIALS)), (F.floor(F.col("doc_id") / 100) % 6).cast("int"))
    have = docs.filter("doc_id % 3 <> 0").select((F.col("doc_id") % 100).alias("asset_id"), material.alias("material"))
    return research.missing(assets, have, MATERIALS)


@query(f"with {HAVE} select asset_id, material from gap")
def missing_materials(spark, d):
    return gaps(spark, d)


@query(f"with {HAVE} select material, count(*) as assets from gap group by material")
def missing_distribution(spark, d):
    return gaps(spark, d).groupBy("material").agg(F.count("*").alias("assets"))


ACTION = "case material " + " ".join(f"when '{m}' then '{a}'" for m, a in research.FILL_ACTIONS.items()) + " end"
STEP = f"case {ACTION} " + " ".join(f"when '{a}' then {i}" for i, a in enumerate(research.ACTION_ORDER, 1)) + " end"


@query(f"with {HAVE} select distinct asset_id, {STEP} as step, {ACTION} as action from gap")
def fill_plan(spark, d):
    return research.fill_plan(gaps(spark, d))


@query(f"with {HAVE} select asset_id, count(*) as missing from gap group by asset_id order by missing desc, asset_id limit 25")
def rescue_targets(spark, d):
    return gaps(spark, d).groupBy("asset_id").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "asset_id").limit(25)


SOCIAL = """
s as (select user_id as asset_id, avg(value) filter (event_type = 'click') as community, avg(value) filter (event_type = 'view') as sentiment,
  avg(value) filter (event_type = 'signup') as trend, avg(value) filter (event_type = 'error') as market from events group by 1),
t as (select *, (community is not null)::int + (sentiment is not null)::int + (trend is not null)::int + (market is not null)::int as dims,
  (coalesce(0.25 * community, 0) + coalesce(0.30 * sentiment, 0) + coalesce(0.25 * trend, 0) + coalesce(0.20 * market, 0))
  / nullif((community is not null)::int * 0.25 + (sentiment is not null)::int * 0.30 + (trend is not null)::int * 0.25 + (market is not null)::int * 0.20, 0) as score from s)"""


def social(spark, d):
    kinds = {"community": "click", "sentiment": "view", "trend": "signup", "market": "error"}
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("asset_id"))
    return research.social_composite(g.agg(*[F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(c) for c, e in kinds.items()]))


@query(f"with {SOCIAL} select asset_id, round(score, 6) as score, dims, case when dims = 4 then 'high' when dims >= 2 then 'medium' when dims = 1 then 'low' else 'not_found' end as confidence from t")
def social_composite(spark, d):
    return social(spark, d).select("asset_id", F.round("score", 6).alias("score"), "dims", "confidence")


@query(f"with {SOCIAL} select asset_id, round(score, 6) as score from t order by round(score, 6) desc nulls last, asset_id limit 20")
def leaderboard(spark, d):
    return social(spark, d).select("asset_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc_nulls_last(), "asset_id").limit(20)


@query(f"with {SOCIAL} select case when sentiment > 65 then 'positive' when sentiment < 35 then 'negative' else 'neutral' end as class, count(*) as assets from t where sentiment is not null group by 1")
def sentiment_distribution(spark, d):
    return social(spark, d).filter("sentiment is not null").groupBy(research.sentiment_class(F.col("sentiment")).alias("class")).agg(F.count("*").alias("assets"))


@query("""with x as (select o_orderkey as asset_id, case o_orderkey % 4 when 0 then 'l2' when 1 then 'meme' when 2 then 'defi' end as sector, o_totalprice as entry_price, o_totalprice * ((70.5 + o_orderkey % 50) / 100) as last_price,
  cast(o_orderdate as date) as target_date, o_orderkey % 7 = 0 as sent, (select cast(max(o_orderdate) as date) - 20 from orders) as as_of from orders),
y as (select *, datediff('day', as_of, target_date) as days_to, last_price / nullif(entry_price, 0) - 1 as chg, case when sector = 'l2' then 21 when sector = 'meme' then null else 14 end as lead from x),
z as (select *, coalesce(days_to >= 0 and days_to <= lead and not sent, false) as unlock_alert, coalesce(chg <= -0.15 and not sent, false) as drop_alert from y)
select asset_id, days_to, round(chg, 8) as price_change, unlock_alert, drop_alert from z where unlock_alert or drop_alert""")
def watchlist_alerts(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("asset_id"), F.when(k % 4 == 0, "l2").when(k % 4 == 1, "meme").when(k % 4 == 2, "defi").alias("sector"), F.col("o_totalprice").alias("entry_price"),
        (F.col("o_totalprice") * ((70.5 + k % 50) / 100)).alias("last_price"), F.to_date("o_orderdate").alias("target_date"), F.when(k % 7 == 0, F.lit("sent")).alias("alert_sent"),
    )
    as_of = F.date_sub(F.lit(last_of(o, "o_orderdate")).cast("date"), 20)
    out = research.watch_alerts(rows, as_of, entities.lead_days(F.col("sector")), 15.0)
    return out.select("asset_id", F.col("days_to").cast("long").alias("days_to"), F.round("drop", 8).alias("price_change"), "unlock_alert", "drop_alert")


POSTS = """
p as (select conv_id, turn, (['prediction', 'analysis', 'after_action'])[turn % 3 + 1] as model, conv_id % 5 = 0 as entered, length(text) % 7 = 0 as pnl, (length(text) % 11) / 10 as confidence from conversations),
q as (select *, case when entered or pnl then 'after_action' else model end as post_type from p)"""


def posts(spark, d):
    n = F.char_length("text")
    model = F.get(F.array(F.lit("prediction"), F.lit("analysis"), F.lit("after_action")), (F.col("turn") % 3).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", model.alias("model"), (F.col("conv_id") % 5 == 0).alias("entered"), (n % 7 == 0).alias("pnl"), ((n % 11) / 10).alias("confidence"))
    return rows.withColumn("post_type", research.post_type(F.col("model"), F.col("entered"), F.col("pnl")))


@query(f"with {POSTS} select conv_id, turn, post_type from q")
def kol_rule_override(spark, d):
    return posts(spark, d).select("conv_id", "turn", "post_type")


@query(f"with {POSTS} select conv_id, turn, confidence from q where post_type = 'prediction' and not entered and confidence >= 0.8")
def kol_alerts(spark, d):
    return posts(spark, d).filter(research.to_alert(F.col("post_type"), F.col("entered"), F.col("confidence"))).select("conv_id", "turn", "confidence")


@query(f"with {POSTS} select conv_id as author, count(*) as signals, round(avg(confidence), 8) as confidence, round(avg(cast(post_type = 'prediction' as int)), 8) as prediction_share from q group by 1")
def author_stats(spark, d):
    return posts(spark, d).groupBy(F.col("conv_id").alias("author")).agg(
        F.count("*").alias("signals"), F.round(F.avg("confidence"), 8).alias("confidence"), F.round(F.avg((F.col("post_type") == "prediction").cast("int")), 8).alias("prediction_share")
    )


@query("select p_partkey as asset_id, regexp_replace(upper(x), '[-_/]?(USDT|USDC|BUSD|USD)$', '') as symbol from (select p_partkey, replace(p_brand, '#', '') || (['usdt', '/USD', '-BUSD', ''])[p_partkey % 4 + 1] as x from part)")
def symbol_strip(spark, d):
    suffix = F.get(F.array(*map(F.lit, ["usdt", "/USD", "-BUSD", ""])), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), entities.base_symbol(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), suffix)).alias("symbol"))


@query("select event_id, cast(json_extract_string(props, '$.k') as double) as k from events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("""with x as (select doc_id, 'see [' || (doc_id % 5) || '] and [' || (doc_id % 9) || '], [2]' as a from documents),
y as (select doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '\\[(\\d{1,6})\\]', 1), lambda x: cast(x as int)), lambda x: x between 1 and 4))) as c from x)
select doc_id, array_to_string(c, ',') as citations from y""".replace("\\\\", "\\"))
def citation_check(spark, d):
    k = F.col("doc_id")
    a = F.concat(F.lit("see ["), (k % 5).cast("string"), F.lit("] and ["), (k % 9).cast("string"), F.lit("], [2]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(research.valid_citations(a, F.lit(4)), lambda x: x.cast("string")), ",").alias("citations"))


@query("select doc_id, source, lang, n_chars from documents order by case lang when 'en' then 0 when 'de' then 1 else 2 end, n_chars desc nulls last, doc_id limit 40")
def evidence_order(spark, d):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").orderBy(rank, F.col("n_chars").desc_nulls_last(), "doc_id").limit(40)


@query("select p_type as sector, min(case p_type when 'x' then 0 else 50 end) as priority, round(avg(1 - p_size / 60), 8) as uncirculated from part group by 1")
def uncirculated_share(spark, d):
    rows = table(spark, d, "part")
    return rows.groupBy(F.col("p_type").alias("sector")).agg(F.min(F.when(F.col("p_type") == "x", 0).otherwise(50)).alias("priority"), F.round(F.avg(1 - F.col("p_size") / 60), 8).alias("uncirculated"))


@query("select source, count(*) as total, count(*) filter (n_chars > 100) as active, round(avg(cast(n_chars > 1000 as int)), 8) as long_share from documents group by source")
def dashboard_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("n_chars") > 100).alias("active"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 8).alias("long_share")
    )


@query("""with x as (select o_custkey as asset_id, cast(o_orderdate as date) as d, o_totalprice / 1e7 as pct, (select cast(max(o_orderdate) as date) - 60 from orders) as as_of from orders)
select asset_id, round(sum(case when d between as_of and as_of + 30 then pct else 0 end), 8) as unlock_30d, count(*) as rounds from x group by 1""")
def unlock_next_30d(spark, d):
    o = table(spark, d, "orders")
    as_of = F.date_sub(F.lit(last_of(o, "o_orderdate")).cast("date"), 60)
    day = F.to_date("o_orderdate")
    soon = F.when(day.between(as_of, F.date_add(as_of, 30)), F.col("o_totalprice") / 1e7).otherwise(0.0)
    return o.groupBy(F.col("o_custkey").alias("asset_id")).agg(F.round(F.sum(soon), 8).alias("unlock_30d"), F.count("*").alias("rounds"))


@query("select user_id as asset_id, max(event_id) as event_id from events where ts >= (select max(ts) from events) - interval 15 minutes group by 1")
def fresh_cache(spark, d):
    e = table(spark, d, "events")
    return e.filter(F.col("ts") >= F.lit(last_of(e, "ts")) - F.expr("interval 15 minutes")).groupBy(F.col("user_id").alias("asset_id")).agg(F.max("event_id").alias("event_id"))

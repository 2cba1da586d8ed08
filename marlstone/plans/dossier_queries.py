"""Queries on materials, intake and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dossier, intake, links, market, posts
from marlstone.operators.research import missing
from marlstone.plans.bindings import ASSETS, assets
from marlstone.plans.link_queries import HOST, LINKS, _case, _topics, found
from marlstone.plans.registry import query
from marlstone.plans.selection_queries import TIER
from marlstone.sources.tables import table

WORDS = "translate(lower(url), '-_', '  ')"


def linked(spark, d):
    """Links of the pages, whose host stands for the asset, with their topics."""
    rows = found(spark, d).filter("page_host <> ''").select(F.col("page_host").alias("asset_id"), "url")
    return rows.withColumn("c", links.classify(F.col("url"), F.lit(None).cast("string"))).select("asset_id", "url", "c.*")


CLASSED = f"""{LINKS}, classed as (select *, {_case("h", links.HOST_TYPES)} as by_host from (select asset_id, url, {HOST} as h, {_topics(WORDS)} as t from (select host as asset_id, url from l where host <> '')))"""


def _map(column: str) -> str:
    return _case(column, dossier.TOPIC_MATERIALS)


TOPICAL = f"{CLASSED}, topical as (select distinct asset_id, {_map('topic')} as material from (select asset_id, unnest(t) as topic from classed) where {_map('topic')} is not null)"
ALL = "(values " + ", ".join(f"('{m}')" for m in dossier.MATERIALS) + ") as m(material)"
SITE = f"select distinct {HOST} as asset_id, 'official_website' as material from pages where {HOST} <> ''"


@query(f"with {TOPICAL} select asset_id, material from topical")
def topic_materials(spark, d):
    return dossier.materials_of_topics(linked(spark, d))


@query(f"with {TOPICAL}, have as (select * from topical union {SITE}), a as (select distinct asset_id from have) select asset_id, material from a, {ALL} where (asset_id, material) not in (select asset_id, material from have)")
def missing_of_21(spark, d):
    sites = table(spark, d, "pages").select(links.host_of(F.col("url")).alias("asset_id")).filter("asset_id <> ''").distinct()
    have = dossier.materials_of_topics(linked(spark, d)).unionByName(sites.withColumn("material", F.lit("official_website")))
    return missing(sites, have, dossier.MATERIALS)


LISTED = {"ECONOMY": ["audit", "tokenomics"], "PROMO": ["exchange_listing", "team_vc"]}


@query(f"""with s as (select distinct p_type as sector from part) select sector, material from s, {ALL}
where material in ({", ".join(f"'{m}'" for m in dossier.BASIC)}) or (material = 'unlocks' and sector <> 'meme')
or (material <> 'unlocks' and ((sector = 'ECONOMY' and material in ('audit', 'tokenomics')) or (sector = 'PROMO' and material in ('exchange_listing', 'team_vc'))))""")
def visible_materials(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("sector")).distinct()
    rows = rows.withColumn("material", F.explode(F.array(*map(F.lit, dossier.MATERIALS))))
    return rows.filter(dossier.visible(F.col("material"), F.col("sector"), LISTED))


@query("""select 'derivatives' as source, l_partkey as asset_id, count(*) as n, cast(max(l_shipdate) as varchar) as latest from lineitem group by 2
union all select 'social', user_id, count(*), cast(max(date_trunc('second', ts)) as varchar) from events group by 2
union all select 'holders', o_custkey, count(*), cast(max(o_orderdate) as varchar) from orders group by 2""")
def asset_snapshot(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "asset_id")
    e = table(spark, d, "events").withColumnRenamed("user_id", "asset_id").withColumn("ts", F.date_trunc("second", "ts"))
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "asset_id")
    rows = dossier.snapshot({"derivatives": (l, "l_shipdate"), "social": (e, "ts"), "holders": (o, "o_orderdate")})
    return rows.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


PARTS = {
    "whitepaper": "select p_partkey from part where p_size > 25", "tokenomics": "select p_partkey from part where p_retailprice > 1000",
    "social": "select user_id from events", "unlocks": "select o_custkey from orders",
    "derivatives": "select l_partkey from lineitem", "onchain": "select l_partkey from lineitem where l_returnflag = 'R'",
}


@query(f"""with {ASSETS}, t as (select {TIER} as tier, {", ".join(f"cast(asset_id in ({q}) as int) as {k}" for k, q in PARTS.items())} from assets)
select coalesce(tier, 'all') as tier, count(*) as assets, {", ".join(f"round(avg({k}), 6) as {k}" for k in PARTS)} from t group by grouping sets ((tier), ())""")
def coverage_six(spark, d):
    part, l = table(spark, d, "part"), table(spark, d, "lineitem")
    ids = lambda rows, c: rows.select(F.col(c).alias("asset_id"))
    parts = {
        "whitepaper": ids(part.filter("p_size > 25"), "p_partkey"), "tokenomics": ids(part.filter("p_retailprice > 1000"), "p_partkey"),
        "social": ids(table(spark, d, "events"), "user_id"), "unlocks": ids(table(spark, d, "orders"), "o_custkey"),
        "derivatives": ids(l, "l_partkey"), "onchain": ids(l.filter("l_returnflag = 'R'"), "l_partkey"),
    }
    return dossier.coverage(assets(spark, d).select("asset_id", market.tier(F.col("rank")).alias("tier")), parts)


def details(spark, d):
    """Suppliers as protocols: JSON of their nation's audits, positive balances as rounds, negative ones as incidents."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "asset_id")
    b = F.col("s_acctbal")
    raised = F.when(b >= 0, F.array(F.struct(F.lit("seed").alias("round"), b.alias("amount"))))
    hacked = F.when(b < 0, F.array(F.struct(F.lit("exploit").alias("kind"), (-b).alias("amount"))))
    audits = F.array(F.concat(F.lit("https://audits.example/"), F.substring("s_name", -1, 1)))
    body = F.to_json(F.struct(audits.alias("audit_links"), raised.alias("raises"), hacked.alias("hacks")))
    ids = s.join(n.filter("n_regionkey <> 0"), F.col("s_nationkey") == F.col("asset_id")).select(F.col("s_suppkey").alias("protocol_id"), "asset_id")
    return intake.mapped(s.select(F.col("s_suppkey").alias("protocol_id"), body.alias("body")), ids)


MAPPED = "from supplier join nation on n_nationkey = s_nationkey where n_regionkey <> 0"


@query(f"select distinct n_nationkey as asset_id, 'https://audits.example/' || right(s_name, 1) as url, 'audit' as topic {MAPPED}")
def third_party_audits(spark, d):
    return intake.audit_links(details(spark, d))


@query(f"select n_nationkey as asset_id, count(*) as rounds, round(sum(s_acctbal), 4) as raised {MAPPED} and s_acctbal >= 0 group by 1")
def third_party_raises(spark, d):
    return intake.raises(details(spark, d)).withColumn("raised", F.round("raised", 4))


@query(f"select n_nationkey as asset_id, 'exploit' as kind, -s_acctbal as amount {MAPPED} and s_acctbal < 0")
def third_party_hacks(spark, d):
    return intake.hacks(details(spark, d))


@query(f"""with {CLASSED}, x as (select url, count(*) as n, any_value(by_host) as b, any_value(t) as t from classed group by url),
y as (select *, case when b is not null then 'domain' when len(t) > 0 then 'keyword' else 'default' end as m from x)
select url, case when m <> 'default' then m when n > 1 then 'ai_content' else 'ai_failed' end as method,
case when m = 'default' and n > 1 then 0.85 when m = 'domain' then 0.98 when m = 'keyword' then 0.6 else 0.3 end :: double as confidence,
case when m = 'default' and n > 1 then 'docs' when len(t) > 0 then array_to_string(t, ',') else 'other' end as topics, m = 'default' and n = 1 as needs_browser from y""")
def classify_in_stages(spark, d):
    """Links without topics pass the rules; a model, which stands for one that read the links found twice, the rest."""
    n = linked(spark, d).groupBy("url").agg(F.count("*").alias("n"))
    none = lambda t: F.lit(None).cast(t)
    rows = n.select("url", none("string").alias("url_key"), none("array<string>").alias("topics"), none("string").alias("method"), none("double").alias("confidence"))
    answers = n.filter("n > 1").select("url", F.array(F.lit("docs")).alias("ai_topics"), F.lit(0.85).alias("ai_confidence"), F.lit("body").alias("reason"))
    out = intake.read_bodies(intake.backfill(intake.backlog(rows)), answers, "url")
    return out.select("url", "method", "confidence", F.array_join("topics", ",").alias("topics"), "needs_browser")


@query(rf"""with {CLASSED} select asset_id, url, coalesce(by_host, 'other') as kind, count(*) as n from classed
where coalesce(by_host, 'other') not in ('twitter', 'reddit', 'telegram') and not regexp_matches(url, '(?i)\.(pdf|png|jpe?g|gif|svg|webp|ico|mp4|zip)([?#].*)?$') group by 1, 2, 3""")
def links_for_curation(spark, d):
    rows = intake.pages_only(intake.for_curation(linked(spark, d).withColumnRenamed("source_type", "kind")))
    return rows.groupBy("asset_id", "url", "kind").agg(F.count("*").alias("n"))


@query(f"with {CLASSED} select asset_id, array_to_string(list_sort(list_distinct(list(h))), ',') as hosts from classed where h <> '' group by asset_id")
def host_sets(spark, d):
    rows = linked(spark, d).select("asset_id", links.host_of(F.col("url")).alias("host"))
    return intake.host_sets(rows).select("asset_id", F.array_join("hosts", ",").alias("hosts"))


@query("select l_partkey as asset_id, count(*) as n from lineitem where cast(l_shipdate as date) = (select cast(max(l_shipdate) as date) from lineitem) group by 1")
def new_links_of_day(spark, d):
    l = table(spark, d, "lineitem")
    last = l.agg(F.max("l_shipdate")).first()[0]
    return intake.new_links(l.withColumnRenamed("l_partkey", "asset_id"), "l_shipdate", F.to_date(F.lit(last)))


@query("select p_partkey as asset_id, p_brand as symbol, p_name as name, case when lower(p_name) = 'no' then 1 when starts_with(lower(p_name), 'cold') then 2 else 3 end as rank, true as inserted from part where contains(lower(p_name), 'cold') and p_size <= 25")
def search_fallback(spark, d):
    """Core has parts of more than 25 that aren't cold, the listing all up to 25: what is sought is only listed."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("contract"), "p_size")
    core = rows.filter("p_size > 25 and not contains(lower(name), 'cold')").drop("p_size")
    return intake.found_or_listed(core, rows.filter("p_size <= 25").drop("p_size"), "cold").drop("contract")


@query("select p_partkey as asset_id, p_brand as symbol from part where p_partkey >= 100")
def assets_since_mark(spark, d):
    return intake.since(table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("symbol")), "asset_id", 100)


#: How a supplier's post writes its nation, by region: as it is, small, as a pair, by alias, unknown.
SAID = "case n_regionkey when 0 then n_name when 1 then lower(n_name) when 2 then n_name || '-USDT' when 3 then 'C' || n_nationkey else 'none' end"


@query(f"""select s_suppkey as post_id, case when n_regionkey <= 3 then n_nationkey end as asset_id, case when n_regionkey <= 1 then 'symbol' when n_regionkey = 2 then 'pair' when n_regionkey = 3 then 'alias' end as matched_by
from supplier left join nation on n_nationkey = s_nationkey""")
def post_assets(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "asset_id")
    said = n.select("asset_id", F.expr(SAID.replace("n_nationkey", "asset_id")).alias("symbol"))
    rows = table(spark, d, "supplier").join(said, F.col("s_nationkey") == F.col("asset_id"), "left").select(F.col("s_suppkey").alias("post_id"), "symbol")
    aliases = n.select("asset_id", F.concat(F.lit("c"), F.col("asset_id").cast("string")).alias("alias"))
    return posts.named_assets(rows, n.select("asset_id", F.col("n_name").alias("symbol")), aliases).select("post_id", "asset_id", "matched_by")


@query("select event_id, user_id as author, event_type as kind from events where event_type in ('click', 'error') and user_id in (1, 2, 3)")
def posts_listed(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("author"), F.col("event_type").alias("kind"))
    return posts.listed(rows, kind=["click", "error"], author=[1, 2, 3])


@query("""with u as (select o_custkey as asset_id, max((o_orderdate, o_orderkey, o_totalprice)) as x from orders group by 1),
f as (select l_partkey as asset_id, max((l_shipdate, l_orderkey, l_linenumber, l_discount, l_quantity)) as y, sum(l_extendedprice) filter (l_returnflag = 'R') as moved from lineitem group by 1)
select event_id, e.user_id as asset_id, x[3] as unlock_value, round(moved, 2) as moved, y[4] as funding, y[5] as oi from events e left join u on u.asset_id = user_id left join f on f.asset_id = user_id where value > 200""")
def alert_enrichment(spark, d):
    signals = table(spark, d, "events").filter("value > 200").select("event_id", F.col("user_id").alias("asset_id"))
    o, l = table(spark, d, "orders").withColumnRenamed("o_custkey", "asset_id"), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "asset_id")
    unlocks = posts.latest(o, "asset_id", ["o_orderdate", "o_orderkey"], {"unlock_value": "o_totalprice"})
    market_now = posts.latest(l, "asset_id", ["l_shipdate", "l_orderkey", "l_linenumber"], {"funding": "l_discount", "oi": "l_quantity"})
    moved = l.filter("l_returnflag = 'R'").groupBy("asset_id").agg(F.round(F.sum("l_extendedprice"), 2).alias("moved"))
    return posts.enriched(signals, [unlocks, moved, market_now])


@query("""with r as (select l_suppkey as author, count(*) as signals, round(avg(case when l_returnflag = 'R' then 0.0 else 1.0 end), 8) as win_rate from lineitem group by 1)
select s_suppkey as author, s_acctbal as followers, coalesce(signals, 0) as signals, win_rate from supplier left join r on author = s_suppkey""")
def author_win_rates(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("author"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("result"))
    profiles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author"), F.col("s_acctbal").alias("followers"))
    return posts.author_stats(rows, profiles).withColumn("win_rate", F.round("win_rate", 8))

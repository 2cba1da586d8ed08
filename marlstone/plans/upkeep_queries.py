"""Noise cleaned at its real limits, gaps filled until a round changes nothing, and selections that take every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import dossier, entities, fill, intake, links, selection
from marlstone.plans.bindings import last_of
from marlstone.plans.registry import query
from marlstone.sources.tables import table
from marlstone.storage import stored

AGGREGATORS, NOISY, AUDITS = ["click.example"], ["error.example"], ["view.example"]

NOISE = """
li as (select event_id as link_id, user_id as asset_id, event_type || '.example' as host, 'https://' || event_type || '.example/' || case when value > 60 then split_part(p_name, ' ', 2) else 'x' end as url, p_name as name
  from events left join part on p_partkey = user_id
  union all select 10000000 + row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity), 1000000 + l_linenumber, case when l_quantity > 48 then 'rare.example' else 'main.example' end, 'https://x', null from lineitem),
ve as (select distinct asset_id, host from li where host in ('main.example', 'rare.example', 'signup.example', 'view.example') or (host = 'purchase.example' and starts_with(name, 'red'))),
co as (select asset_id, host, count(*) as n, count(*) / sum(count(*)) over (partition by asset_id) as share, count(*) over (partition by host) as assets from li group by 1, 2),
cl as (select link_id, case when li.host = 'click.example' then 'aggregator' when li.host = 'view.example' and n > 5 and not coalesce(contains(url, split_part(name, ' ', 2)) or contains(url, split_part(name, ' ', 1)), false) then 'crowd' when li.host = 'error.example' then 'rule'
  when ve.host is null then 'kept' when li.host = 'view.example' then 'audit' when n > 100 and share > 0.9 then 'reset' when assets > 50 then 'shared' else 'model' end as layer
  from li join co using (asset_id, host) left join ve using (asset_id, host))"""


def page_links(spark, d):
    """Links of the events' assets to a host for each kind, and of seven assets with nearly all of their links on one host."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"))
    host = F.concat("event_type", F.lit(".example"))
    e = table(spark, d, "events").withColumnRenamed("user_id", "asset_id").join(p, "asset_id", "left")
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.when(F.col("value") > 60, F.split_part("name", F.lit(" "), F.lit(2))).otherwise("x"))
    e = e.select(F.col("event_id").alias("link_id"), "asset_id", host.alias("host"), url.alias("url"), "name")
    main = F.when(F.col("l_quantity") > 48, "rare.example").otherwise("main.example")
    l = table(spark, d, "lineitem").select(F.lit(None).cast("long").alias("link_id"), (F.col("l_linenumber") + 1_000_000).cast("long").alias("asset_id"), main.alias("host"), F.lit("https://x").alias("url"), F.lit(None).cast("string").alias("name"))
    return e.unionByName(l).withColumn("symbol", F.lit(None).cast("string"))


@query(f"with {NOISE} select layer, count(*) as links, layer in ('kept', 'audit', 'shared', 'reset') as kept from cl group by 1")
def noise_layers(spark, d):
    """How many links each layer decides on."""
    rows = page_links(spark, d)
    judged = F.col("host").isin("main.example", "rare.example", "signup.example", "view.example") | ((F.col("host") == "purchase.example") & F.col("name").startswith("red"))
    out = links.cleaned(rows, rows.filter(judged).select("asset_id", "host"), AGGREGATORS, NOISY, AUDITS)
    return out.groupBy("layer", "kept").agg(F.count("*").alias("links"))


@query(f"with {NOISE} select link_id, layer from cl where link_id < 10000000")
def noise_cleaned(spark, d):
    """The layer that decides on each link of the events' assets."""
    rows = page_links(spark, d)
    judged = F.col("host").isin("main.example", "rare.example", "signup.example", "view.example") | ((F.col("host") == "purchase.example") & F.col("name").startswith("red"))
    return links.cleaned(rows, rows.filter(judged).select("asset_id", "host"), AGGREGATORS, NOISY, AUDITS).filter("link_id is not null").select("link_id", "layer")


_MATERIALS = "['" + "', '".join(dossier.MATERIALS) + "']"
FILLED = f"""
po as (select l_suppkey as asset_id, ({_MATERIALS})[l_quantity::int % 21 + 1] as material, min(l_linenumber) as depth from lineitem where l_returnflag = 'R' and l_discount >= 0.095 group by 1, 2),
de as (select distinct depth from po where material <> 'contract'),
en as (select min(k) as k from range(1, 9) r(k) where k not in (select depth from de)),
ha as (select asset_id, material, depth from po, en where depth < k and material <> 'contract')"""


def actions(spark, d):
    """Each action finds what returned lines say of an asset, in the round of their line number; no action looks for contracts."""
    material = F.get(F.array(*map(F.lit, dossier.MATERIALS)), F.col("l_quantity").cast("int") % 21)
    pool = stored(table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount >= 0.095D").select(F.col("l_suppkey").alias("asset_id"), material.alias("material"), F.col("l_linenumber").alias("depth")).distinct(), "fill-pool")

    def found(targets, number):
        return pool.filter((F.col("depth") <= number) & (F.col("material") != "contract"))

    return dict.fromkeys(fill.ORDER, found)


def filled(spark, d):
    assets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"))
    return fill.whole(*fill.fill_until_done(assets, spark.createDataFrame([], "asset_id long, material string"), actions(spark, d)))


@query(f"with {FILLED} select asset_id, material from ha")
def materials_filled(spark, d):
    """What the assets have once a round changes nothing; a failure of the last round is raised, not left out."""
    return filled(spark, d)[0]


@query(f"with {FILLED} select k as round, (select count(*) from ha where depth = k) as closed, (select count(*) * 21 from supplier) - (select count(*) from ha where depth <= k) as pending from range(1, 9) r(k) where k <= (select k from en)")
def fill_rounds(spark, d):
    """What each round closed and left, until one that closed nothing."""
    report = filled(spark, d)[1]
    return report.groupBy(F.col("round").cast("long").alias("round")).agg(F.sum("closed").alias("closed"), F.min("pending").alias("pending"))


#: Words of part names as tags, so that every sector has assets.
WORDS = {"red": "layer-1", "blue": "layer-2", "small": "defi", "large": "memes", "hot": "gaming", "cold": "ai", "old": "rwa"}
TAGGED = f"""
tg as (select p_partkey as asset_id, case split_part(p_name, ' ', 1) {" ".join(f"when '{k}' then '{v}'" for k, v in WORDS.items())} end as tag from part), ms(c, s, t) as (values {", ".join(f"({v[1]}, '{v[0]}', '{k}')" for k, v in entities.TAG_SECTORS.items())}),
sr as (select asset_id, coalesce(s, 'other') as sector from tg left join ms on ms.t = tg.tag)"""


def sectors(spark, d):
    word, tag = F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(None).cast("string")
    for k, v in WORDS.items():
        tag = F.when(word == k, v).otherwise(tag)
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), entities.sector_of(F.array(tag)).alias("sector"))


@query(f"with {TAGGED} select asset_id, sector, case sector when 'l2' then 95 when 'ai' then 90 when 'meme' then 45 else 70 end as priority, case sector when 'l2' then 21 when 'ai' then 21 when 'meme' then null else 14 end as lead_days from sr")
def sector_priorities(spark, d):
    """Collection priority and lead days of assets of every sector."""
    return sectors(spark, d).select("asset_id", "sector", selection.collect_priority(F.col("sector")).alias("priority"), entities.lead_days(F.col("sector")).alias("lead_days"))


@query("""with x as (select o_orderkey as doc_id, o_custkey as asset_id, case left(o_orderpriority, 1) when '1' then 'whitepaper' when '2' then 'tokenomics' when '3' then 'audit' else 'other' end as kind, cast(o_orderdate as date) as published_at from orders),
r as (select *, case kind when 'whitepaper' then 1 when 'tokenomics' then 2 when 'audit' then 3 else 4 end as k from x)
select asset_id, doc_id, kind, published_at, row_number() over (partition by asset_id order by k, published_at desc nulls last, doc_id) as place from r qualify place <= 20""", date="published_at")
def evidence_by_type(spark, d):
    """The evidence of each asset: by type first, then the newest."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "whitepaper").when(F.col("o_orderpriority").startswith("2"), "tokenomics").when(F.col("o_orderpriority").startswith("3"), "audit").otherwise("other")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("doc_id"), kind.alias("kind"), F.to_date("o_orderdate").alias("published_at"))
    return dossier.evidence(rows).withColumn("place", F.col("place").cast("long"))


@query("""with x as (select p_partkey as asset_id, p_retailprice as price, (select max(l_shipdate) from lineitem where l_partkey = p_partkey) as seen, (select max(l_shipdate) from lineitem) as now, p_size from part),
y as (select *, case when seen > now - interval 60 day then 'cache' when p_size % 4 = 0 then 'site' when p_size % 4 = 1 then 'given' when price >= 1000 then 'model' end as tier from x)
select asset_id, coalesce(tier, 'refused') as tier, case when tier is null then 'price' end as missing from y""")
def unlock_tiers(spark, d):
    """Where an unlock plan is from: a fresh cache, the site, an address that the user gave, a model; without a price none is asked."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    seen = l.groupBy(F.col("l_partkey").alias("asset_id")).agg(F.max("l_shipdate").alias("seen"))
    now = F.lit(last_of(l, "l_shipdate")).cast(l.schema["l_shipdate"].dataType)
    rows = p.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).alias("price"), "p_size").join(seen, "asset_id", "left")
    have = {"cache": F.col("seen") > now - F.expr("interval 60 days"), "site": F.col("p_size") % 4 == 0, "given": F.col("p_size") % 4 == 1}
    return intake.unlock_source(rows, have, ["price"]).select("asset_id", "tier", F.array_join("missing", ",").alias("missing")).withColumn("missing", F.nullif("missing", F.lit("")))


@query("""with m as (select conv_id, turn from conversations), n as (select distinct conv_id from conversations), gone as (select conv_id from n where conv_id in (select c_custkey from customer where c_acctbal < 0))
select conv_id, turn from m where conv_id not in (select conv_id from gone)""")
def notebooks_deleted(spark, d):
    """Messages left once notebooks are deleted: theirs go with them."""
    from marlstone.operators import keyed

    m = table(spark, d, "conversations").select("conv_id", "turn")
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("conv_id"))
    return keyed.without(m, gone, ["conv_id"])


@query("""with w as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice * 2 as usd from lineitem), s as (select distinct l_orderkey from lineitem where l_linestatus = 'F' and l_returnflag = 'R'), r as (select p_partkey from part where starts_with(p_name, 'large'))
select l_orderkey, l_linenumber, max(usd) as usd from w where usd >= 100000 and l_partkey in (select p_partkey from r) and l_orderkey not in (select l_orderkey from s) group by 1, 2""")
def meme_alerts_unsent(spark, d):
    """Large transfers of meme assets that no alert was sent of."""
    from marlstone.operators import flows, keyed

    l = table(spark, d, "lineitem")
    memes = sectors(spark, d).filter("sector = 'meme'").select(F.col("asset_id").alias("l_partkey"))
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * 2).alias("usd")).filter("usd >= 100000").join(memes, "l_partkey", "left_semi")
    sent = l.filter("l_linestatus = 'F' and l_returnflag = 'R'").select("l_orderkey")
    return flows.keep_one(keyed.without(rows, sent, ["l_orderkey"]), ["l_orderkey", "l_linenumber"], [F.desc("usd")]).select("l_orderkey", "l_linenumber", "usd")

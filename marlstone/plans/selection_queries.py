"""Queries on what is worked on next, within a market tier, and on what a round changed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import entities, market, selection
from marlstone.plans.bindings import ASSETS, assets, last_of
from marlstone.plans.entity_queries import BACK, FIGURES, SECTORS, backtest
from marlstone.plans.registry import query
from marlstone.plans.research_queries import HAVE, SOCIAL, gaps, social
from marlstone.sources.tables import table

TIER = "case when rank <= 100 then 'top100' when rank <= 500 then 'top500' when rank <= 1000 then 'top1000' else 'other' end"
#: Order of the topics of a sector in this query.
TOPICS = {"ECONOMY": ["audit", "tokenomics"], "PROMO": ["whitepaper", "docs", "unlocks"]}


def in_tier(rows, spark, d, tier: str):
    """The rows of a market tier's assets: the first 1,000 ranks at most, or the rest."""
    own = assets(spark, d).filter(market.tier(F.col("rank")) == tier).select("asset_id")
    return rows.join(own, "asset_id", "left_semi")


@query(f"""with {ASSETS}, x as (select *, {TIER} as tier from assets)
select asset_id, symbol, name, case when lower(symbol) = 'brand#1' then 1 when starts_with(lower(symbol), 'brand#1') or starts_with(lower(name), 'brand#1') then 2 else 3 end as rank
from x where tier = 'top100' and (contains(lower(symbol), 'brand#1') or contains(lower(name), 'brand#1'))""")
def search_in_tier(spark, d):
    rows = in_tier(assets(spark, d), spark, d, "top100").withColumn("contract", F.lit(None).cast("string"))
    return entities.search(rows, "Brand#1").select("asset_id", "symbol", "name", "rank")


@query(f"""with {ASSETS}, {SOCIAL}, r as (select t.asset_id, round(score, 6) as score, {TIER} as tier from t join assets using (asset_id))
select tier, asset_id, score, row_number() over (partition by tier order by score desc nulls last, asset_id) as place from r qualify place <= 10""")
def leaderboard_by_tier(spark, d):
    tiers = assets(spark, d).select("asset_id", market.tier(F.col("rank")).alias("tier"))
    rows = social(spark, d).select("asset_id", F.round("score", 6).alias("score")).join(tiers, "asset_id")
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.col("score").desc_nulls_last(), "asset_id"))
    return rows.withColumn("place", place).filter("place <= 10").select("tier", "asset_id", "score", F.col("place").cast("long").alias("place"))


PRIORITY = "case sector when 'l2' then 95 when 'ai' then 90 when 'meme' then 45 else 70 end"


@query(f"""with t as (select p_partkey as asset_id, unnest(string_split(lower(p_name), ' ')) as t from part), m(c, s, t) as (values {SECTORS}),
b as (select asset_id, max((c, s)) as x from t join m using (t) group by 1), s as (select p_partkey as asset_id, coalesce(x[2], 'other') as sector from part left join b on asset_id = p_partkey)
select asset_id, sector, {PRIORITY} as priority from s""")
def collection_priority(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), entities.sector_of(F.split(F.lower("p_name"), " ")).alias("sector"))
    return rows.withColumn("priority", selection.collect_priority(F.col("sector")))


RANK = "case when material = 'official_website' then 0 when sector = 'ECONOMY' then case material when 'audit' then 1 when 'tokenomics' then 2 else 4 end when sector = 'PROMO' then case material when 'whitepaper' then 1 when 'docs' then 2 when 'unlocks' then 3 else 4 end else 4 end"


@query(f"with {HAVE}, s as (select p_partkey as asset_id, split_part(p_type, ' ', 1) as sector from part) select asset_id, material, {RANK} as place from gap left join s using (asset_id)")
def gap_order(spark, d):
    sectors = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sector"))
    rows = gaps(spark, d).join(sectors, "asset_id", "left")
    return rows.select("asset_id", "material", selection.gap_rank(F.col("material"), F.col("sector"), TOPICS).alias("place"))


@query("select o_orderkey, o_custkey from orders where o_orderkey > 1000 order by 1 limit 500")
def page_after(spark, d):
    return selection.next_page(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 500)


@query("""with m as (select max(o_orderdate) as t from orders), b as (select distinct o_custkey from orders, m where o_orderdate <= t - interval 2 year), a as (select distinct o_custkey from orders, m where o_orderdate > t - interval 2 year)
select o_custkey, 'closed' as change from b where o_custkey not in (select * from a) union all select o_custkey, 'opened' from a where o_custkey not in (select * from b)""")
def gap_changes(spark, d):
    o = table(spark, d, "orders")
    last = F.lit(last_of(o, "o_orderdate")).cast(o.schema["o_orderdate"].dataType)
    rows = o.withColumn("old", F.col("o_orderdate") <= last - F.expr("interval 2 year"))
    return selection.gap_changes(rows.filter("old"), rows.filter("not old"), ["o_custkey"])


@query("select l_suppkey as asset_id, count(*) as n from lineitem group by 1 having count(*) > 500")
def crowded_assets(spark, d):
    return selection.crowded(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset_id")))


@query("""select l_orderkey, l_linenumber, l_suppkey as asset_id from lineitem
where not (l_returnflag = 'R' and l_suppkey in (select l_suppkey from lineitem group by 1 having count(*) > 500))""")
def crowded_reset(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("asset_id"), F.col("l_returnflag").alias("source"))
    return selection.reset_crowded(rows, kind="R").drop("source")


@query(f"with {BACK} select band, {FIGURES} from b group by band")
def backtest_on_prices(spark, d):
    return backtest(spark, d, [["band"]]).drop("sector")

"""Queries on assets: matching, search, tiers, sectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import entities, flows, keyed, market
from marlstone.plans.bindings import ASSETS, DAILY, assets, daily
from marlstone.plans.registry import query
from marlstone.sources.tables import table

SIDES = """
l as (select p_partkey as id, 'SYM' || (p_partkey % 400) as symbol, case when p_partkey % 3 <> 0 then (case when p_partkey % 2 = 0 then '0xAB' else 'Base' end) || (p_partkey % 700) end as contract from part),
r as (select s_suppkey as id, 'sym' || (s_suppkey % 400) as symbol, case when s_suppkey % 4 <> 0 then (case when s_suppkey % 2 = 0 then '0xab' else 'Base' end) || (s_suppkey % 700) end as contract from supplier),
ln as (select id as left_id, upper(symbol) as s, case when regexp_matches(contract, '^0[xX]') then lower(contract) else contract end as c from l),
rn as (select id as right_id, upper(symbol) as s, case when regexp_matches(contract, '^0[xX]') then lower(contract) else contract end as c from r),
bc as (select left_id, right_id, 'contract' as matched_by from ln join rn on ln.c = rn.c),
bs as (select left_id, right_id, 'symbol' as matched_by from ln join rn on ln.s = rn.s where (ln.c is null or rn.c is null)
  and left_id not in (select left_id from bc) and right_id not in (select right_id from bc)),
m as (select * from bc union all select * from bs)"""


def sides(spark, d):
    def side(df, key, symbol, zero, every):
        k = F.col(key)
        contract = F.when(k % every != 0, F.concat(F.when(k % 2 == 0, zero).otherwise("Base"), (k % 700).cast("string")))
        return df.select(k.alias("id"), F.concat(F.lit(symbol), (k % 400).cast("string")).alias("symbol"), contract.alias("contract"))

    return side(table(spark, d, "part"), "p_partkey", "SYM", "0xAB", 3), side(table(spark, d, "supplier"), "s_suppkey", "sym", "0xab", 4)


@query(f"with {SIDES} select * from m")
def cross_source_match(spark, d):
    return entities.cross_match(*sides(spark, d))


@query(f"with {SIDES} select l.id as asset_id, case when m.left_id is null then '1/3' else '2/3' end as consensus from l left join (select distinct left_id from m) m on l.id = m.left_id")
def consensus(spark, d):
    l, r = sides(spark, d)
    hit = entities.cross_match(l, r).select(F.col("left_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    return l.join(hit, "id", "left").select(F.col("id").alias("asset_id"), F.when(F.col("hit").isNull(), "1/3").otherwise("2/3").alias("consensus"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def source_only_assets(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return keyed.without(rows, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""select l_partkey as asset_id, s_nationkey as protocol, n_name as chain, count(*) as rows_mapped
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_regionkey < 3 group by 1, 2, 3""")
def protocol_map(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    n = table(spark, d, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = l.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_partkey").alias("asset_id"), F.col("s_nationkey").alias("protocol"), F.col("n_name").alias("chain")).agg(F.count("*").alias("rows_mapped"))


@query("""with x as (select p_partkey as asset_id, p_brand as symbol, p_name as name from part),
r as (select *, case when lower(symbol) = 'brand#12' then 1 when starts_with(lower(symbol), 'brand#12') or starts_with(lower(name), 'brand#12') then 2
  when contains(lower(symbol), 'brand#12') or contains(lower(name), 'brand#12') then 3 end as rank from x)
select asset_id, symbol, name, rank from r where rank is not null order by rank, name, asset_id limit 50""")
def search_ranked(spark, d):
    return search_text(spark, d, "Brand#12")


def listed(spark, d):
    """All assets as they are searched: without their market rank, with a contract made of the name and key, which the tables lack."""
    k = F.col("p_partkey")
    digest = F.md5(F.concat_ws(" ", "p_name", k.cast("string")))
    contract = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("0x"), F.upper(F.substring(digest, 1, 16)))).when(F.col("p_size") % 3 == 2, F.concat(F.lit("So"), F.substring(digest, 1, 16)))
    return table(spark, d, "part").select(k.alias("asset_id"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), contract.alias("contract"))


LISTED = """
listed as (select p_partkey as asset_id, p_brand as symbol, p_name as name,
  case p_size % 3 when 1 then '0x' || upper(substr(md5(p_name || ' ' || p_partkey), 1, 16)) when 2 then 'So' || substr(md5(p_name || ' ' || p_partkey), 1, 16) end as contract from part)"""


def search_text(spark, d, text, rows=None):
    found = entities.search(listed(spark, d) if rows is None else rows, text)
    return found.orderBy("rank", "name", "asset_id").limit(50).select("asset_id", "symbol", "name", "rank")


@query(f"with {ASSETS} select asset_id, rank, case when rank <= 100 then 'top100' when rank <= 500 then 'top500' when rank <= 1000 then 'top1000' else 'other' end as tier from assets")
def market_tiers(spark, d):
    return assets(spark, d).select("asset_id", "rank", market.tier(F.col("rank")).alias("tier"))


@query(f"""with {ASSETS}, t as (select a.*, case when rank <= 100 then 'top100' when rank <= 500 then 'top500' when rank <= 1000 then 'top1000' else 'other' end as tier,
  cast(a.asset_id in (select l_partkey from lineitem) as int) as traded, cast(a.asset_id in (select l_partkey from lineitem where l_returnflag = 'R') as int) as returned, cast(size > 25 as int) as has_docs from assets a)
select coalesce(tier, 'all') as tier, count(*) as assets, round(avg(traded), 6) as traded, round(avg(returned), 6) as returned, round(avg(has_docs), 6) as has_docs from t group by grouping sets ((tier), ())""")
def coverage_by_tier(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("asset_id")).agg(F.lit(1).alias("traded"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    rows = assets(spark, d).join(l, "asset_id", "left").withColumn("tier", market.tier(F.col("rank"))).fillna(0, ["traded", "returned"])
    rows = rows.withColumn("has_docs", (F.col("size") > 25).cast("int"))
    g = rows.groupingSets([[F.col("tier")], []], F.col("tier")).agg(F.count("*").alias("assets"), *[F.round(F.avg(c), 6).alias(c) for c in ("traded", "returned", "has_docs")])
    return g.withColumn("tier", F.coalesce("tier", F.lit("all")))


@query("""with s as (select p_type as sector, p_brand as symbol, p_partkey as asset_id, p_retailprice as score, (p_size - 25) / 100 as chg from part),
g as (select sector, count(*) as assets, avg(chg) as chg, avg(score) as score, arg_max(symbol, (score, -asset_id)) as leader from s group by sector)
select sector, assets, round(chg, 6) as change_24h, round(score, 4) as mean_score, leader,
  round(50 * coalesce((assets - min(assets) over ()) / nullif(max(assets) over () - min(assets) over (), 0), 0) + 50 * coalesce((score - min(score) over ()) / nullif(max(score) over () - min(score) over (), 0), 0), 4) as heat from g""")
def sector_heatmap(spark, d):
    rows = assets(spark, d)
    leader = F.max_by("symbol", F.struct("price", -F.col("asset_id")))
    g = rows.groupBy("sector").agg(F.count("*").alias("assets"), F.avg((F.col("size") - 25) / 100).alias("chg"), F.avg("price").alias("score"), leader.alias("leader"))
    every = Window.partitionBy()  # a row for each sector
    heat = 0.5 * market.scale_100(F.col("assets"), every) + 0.5 * market.scale_100(F.col("score"), every)
    return g.select("sector", "assets", F.round("chg", 6).alias("change_24h"), F.round("score", 4).alias("mean_score"), "leader", F.round(heat, 4).alias("heat"))


@query("""with t as (select p_partkey as target, p_type from part where p_partkey <= 5),
m as (select l_partkey, round(sum(l_quantity), 2) as volume, count(*) as rounds from lineitem group by 1)
select target, p.p_partkey as asset_id, p.p_partkey = target as is_target, p_retailprice as price, coalesce(volume, 0) as volume, coalesce(rounds, 0) as rounds,
  row_number() over (partition by target order by p.p_partkey = target desc, coalesce(volume, 0) desc, p.p_partkey) as position
from t join part p on p.p_type = t.p_type left join m on m.l_partkey = p.p_partkey qualify position <= 10""")
def sector_competitors(spark, d):
    return competitors(spark, d).filter("target <= 5")


def competitors(spark, d):
    """Every asset as target, first, then the nine of its sector with the greatest volume: ten rows of a sector are joined."""
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("volume"), F.count("*").alias("rounds"))
    rows = table(spark, d, "part").join(m, F.col("p_partkey") == F.col("l_partkey"), "left").fillna(0, ["volume", "rounds"])
    rows = rows.filter("p_type is not null").select("p_type", F.col("p_partkey").alias("asset_id"), F.col("p_retailprice").alias("price"), "volume", "rounds")
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("volume"), "asset_id"))).filter("place <= 10")
    own = best.select(F.col("asset_id").alias("target"), F.col("place").alias("own"))
    targets = rows.select(F.col("asset_id").alias("target"), "p_type").join(own, "target", "left")
    # Those before the target move down by one place.
    others = targets.join(best, "p_type").filter("asset_id <> target").withColumn("position", F.col("place") + (F.col("own").isNull() | (F.col("place") < F.col("own"))).cast("int"))
    first = rows.withColumns({"target": F.col("asset_id"), "is_target": F.lit(True), "position": F.lit(1)})
    columns = ["target", "asset_id", "is_target", "price", "volume", "rounds", F.col("position").cast("long").alias("position")]
    return first.select(columns).unionByName(others.filter("position <= 10").withColumn("is_target", F.lit(False)).select(columns))


WEIGHTS = "(values ('ECONOMY', 0.2, 0.3, 0.2, 0.2, 0.1), ('PROMO', 0.1, 0.4, 0.1, 0.3, 0.1)) as w(sector, w1, w2, w3, w4, w5)"
SCORE = f"""
f as (select p_partkey as asset_id, split_part(p_type, ' ', 1) as sector, p_brand as symbol, least(100, coalesce(sum(l_quantity), 0) / 10) as volume, least(100, count(l_orderkey) * 2.0) as txns, coalesce(avg(l_discount), 0) * 1000 as momentum,
  coalesce(avg(case when l_returnflag = 'R' then 0.0 else 100.0 end), 0) as buy_ratio, p_size * 2.0 as change
  from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_type, p_brand, p_size),
scored as (select f.*, coalesce(w1, 0.2) * volume + coalesce(w2, 0.2) * momentum + coalesce(w3, 0.2) * buy_ratio + coalesce(w4, 0.2) * change + coalesce(w5, 0.2) * txns as score from f left join {WEIGHTS} using (sector))"""


def scores(spark, d):
    p, l = table(spark, d, "part"), table(spark, d, "lineitem")
    g = l.groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("m"), F.avg(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(100.0)).alias("b")
    )
    rows = p.join(g, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("asset_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sector"), F.col("p_brand").alias("symbol"),
        F.least(F.lit(100.0), F.coalesce("q", F.lit(0.0)) / 10).alias("volume"), F.least(F.lit(100.0), F.coalesce("n", F.lit(0)) * 2.0).alias("txns"), (F.coalesce("m", F.lit(0.0)) * 1000).alias("momentum"),
        F.coalesce("b", F.lit(0.0)).alias("buy_ratio"), (F.col("p_size") * 2.0).alias("change"),
    )
    weights = spark.sql(f"select * from {WEIGHTS}")
    rows = rows.join(F.broadcast(weights), "sector", "left")
    part = lambda w, c: F.coalesce(F.col(w).cast("double"), F.lit(0.2)) * F.col(c)
    return rows.withColumn("score", part("w1", "volume") + part("w2", "momentum") + part("w3", "buy_ratio") + part("w4", "change") + part("w5", "txns"))


@query(f"with {SCORE} select asset_id, sector, round(score, 5) as score from scored")
def recommendation_score(spark, d):
    return scores(spark, d).select("asset_id", "sector", F.round("score", 5).alias("score"))


BACK = f"""{DAILY}, {SCORE}, e as (select asset_id, arg_min(price, trade_date) as entry, arg_max(price, trade_date) as now from daily group by 1),
b as (select sector, case when round(score, 5) >= 70 then '>=70' when round(score, 5) >= 50 then '50-70' else '<50' end as band, now / nullif(entry, 0) - 1 as ret from e join scored using (asset_id))"""


def backtest(spark, d, sets):
    """Returns of the scored assets, entered at their first day's price, against their last day's, by sets of band and sector."""
    prices = daily(spark, d).groupBy("asset_id").agg(F.min_by("price", "trade_date").alias("entry"), F.max_by("price", "trade_date").alias("now"))
    s, ret = F.round("score", 5), F.col("ret")
    band = F.when(s >= 70, ">=70").when(s >= 50, "50-70").otherwise("<50")
    rows = scores(spark, d).join(prices, "asset_id").select("sector", band.alias("band"), (F.try_divide("now", "entry") - 1).alias("ret"))
    gain, loss = F.sum(F.when(ret > 0, ret).otherwise(0.0)), -F.sum(F.when(ret < 0, ret).otherwise(0.0))
    return rows.groupingSets([[F.col(c) for c in g] for g in sets], F.col("band"), F.col("sector")).agg(
        F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_return"), F.round(F.avg((ret > 0).cast("int")), 6).alias("win_rate"),
        F.round(F.median("ret"), 6).alias("median_return"), F.round(F.try_divide(gain, loss), 6).alias("profit_factor"), F.round(F.max("ret"), 6).alias("best"), F.round(F.min("ret"), 6).alias("worst"),
    )


FIGURES = """count(*) as n, round(avg(ret), 6) as mean_return, round(avg(cast(ret > 0 as int)), 6) as win_rate, round(median(ret), 6) as median_return,
round(sum(case when ret > 0 then ret else 0 end) / nullif(-sum(case when ret < 0 then ret else 0 end), 0), 6) as profit_factor, round(max(ret), 6) as best, round(min(ret), 6) as worst"""


@query(f"with {BACK} select coalesce(band, 'all') as band, coalesce(sector, 'all') as sector, {FIGURES} from b group by grouping sets ((band), (sector), ())")
def backtest_stratified(spark, d):
    g = backtest(spark, d, [["band"], ["sector"], []])
    return g.withColumns({"band": F.coalesce("band", F.lit("all")), "sector": F.coalesce("sector", F.lit("all"))})


@query("""with o as (select o_orderkey, o_custkey, o_orderdate, o_totalprice from orders where o_orderkey % 3 <> 0),
n as (select o_orderkey - 1 as o_orderkey, o_custkey, o_orderdate + interval 1 day as o_orderdate, o_totalprice from orders where o_orderkey % 3 = 2),
u as (select *, 0 as f from o union all select *, 1 from n)
select o_orderkey, o_custkey, o_orderdate, o_totalprice from u qualify row_number() over (partition by o_orderkey order by o_orderdate desc, f desc, o_totalprice desc) = 1""")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    new = o.filter("o_orderkey % 3 = 2").withColumns({"o_orderkey": F.col("o_orderkey") - 1, "o_orderdate": F.col("o_orderdate") + F.expr("interval 1 day")})
    return keyed.upsert(o.filter("o_orderkey % 3 <> 0"), new, ["o_orderkey"], [F.col("o_orderdate")])


@query("select sha256(text) as content_hash, min(doc_id) as doc_id from documents group by 1")
def content_hash_dedup(spark, d):
    rows = table(spark, d, "documents").select(keyed.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("""select p_partkey as asset_id, coalesce(case when p_size % 5 = 0 then cast(p_size as double) end, case when p_size % 3 = 0 then cast(p_size as double) * 2 end, case when p_size % 2 = 0 then cast(p_size as double) * 3 end) as supply,
case when p_size % 5 = 0 then 1 when p_size % 3 = 0 then 2 else 3 end as tier from part where p_size % 5 = 0 or p_size % 3 = 0 or p_size % 2 = 0""")
def fallback_tiers(spark, d):
    p = table(spark, d, "part")
    source = lambda every, tier: p.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_size") % every == 0, F.col("p_size") * float(tier)).alias("supply"), F.lit(tier).alias("tier"))
    rows = source(5, 1).unionByName(source(3, 2)).unionByName(source(2, 3))
    return keyed.first_source(rows, ["asset_id"], "tier", "supply")


@query("select n_nationkey, case when regexp_matches(a, '^0[xX]') then lower(a) else a end as address from (select n_nationkey, case when n_nationkey % 2 = 0 then '0xAbC' || n_name else 'So1' || n_name end as a from nation)")
def address_normalize(spark, d):
    a = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "0xAbC").otherwise("So1"), "n_name")
    return table(spark, d, "nation").select("n_nationkey", entities.normal_address(a).alias("address"))


TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query(f"select a.n_name as a, b.n_name as b, round(len(list_intersect({TRI.format('a.n_name')}, {TRI.format('b.n_name')})) / len(list_distinct(list_concat({TRI.format('a.n_name')}, {TRI.format('b.n_name')}))), 8) as similarity from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def trigram_similarity(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), "n_regionkey"), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), "n_regionkey")
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b", F.round(entities.trigram_similarity(F.col("a"), F.col("b")), 8).alias("similarity"))


SECTORS = ", ".join(f"({v[1]}, '{v[0]}', '{k}')" for k, v in entities.TAG_SECTORS.items())


@query(f"""with tags as (select p_partkey, unnest([(['layer-1', 'layer-2', 'defi', 'memes', 'gaming', 'ai', 'rwa', 'none'])[p_partkey % 8 + 1], (['layer-1', 'layer-2', 'defi', 'memes', 'gaming', 'ai', 'rwa', 'none'])[p_size % 8 + 1]]) as t from part),
m(c, s, t) as (values {SECTORS}), b as (select p_partkey, max((c, s)) as x from tags join m using (t) group by 1)
select p.p_partkey as asset_id, coalesce(x[2], 'other') as sector from part p left join b using (p_partkey)""")
def sector_normalize(spark, d):
    names = F.array(*[F.lit(x) for x in ("layer-1", "layer-2", "defi", "memes", "gaming", "ai", "rwa", "none")])
    tags = F.array(F.get(names, (F.col("p_partkey") % 8).cast("int")), F.get(names, F.col("p_size") % 8))
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), entities.sector_of(tags).alias("sector"))


@query("select p_partkey as asset_id, p_type from part where p_retailprice >= 1500 or p_size in (1, 7, 49)")
def target_selection(spark, d):
    return table(spark, d, "part").filter((F.col("p_retailprice") >= 1500) | F.col("p_size").isin(1, 7, 49)).select(F.col("p_partkey").alias("asset_id"), "p_type")


@query("""select o_custkey as asset_id, cast(o_orderdate as date) as rec_date, min(o_totalprice) as price from orders group by 1, 2""", date="rec_date")
def recommendation_archive(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.to_date("o_orderdate").alias("rec_date"), F.col("o_totalprice").alias("price"))
    return flows.keep_one(o, ["asset_id", "rec_date"], [F.asc("price")])

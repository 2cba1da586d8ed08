"""Rows out of what sources answer: the JSON, XML and pages that were landed, by their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.entities import normal_address

# The shape of each source's answers, as far as it is read.
MAP = "data array<struct<id:long,name:string,symbol:string,slug:string,rank:long,is_active:int,platform:struct<symbol:string,token_address:string>>>"
_USD = "struct<USD:struct<price:double,market_cap:double,fully_diluted_market_cap:double,volume_24h:double,percent_change_24h:double,percent_change_7d:double,last_updated:string>>"
QUOTES = f"data map<string,struct<id:long,symbol:string,circulating_supply:double,total_supply:double,quote:{_USD}>>"
COIN = "id string, symbol string, name string, categories array<string>, platforms map<string,string>, links struct<homepage:array<string>,whitepaper:string,repos_url:struct<github:array<string>>,subreddit_url:string>"
PROTOCOLS = "array<struct<id:string,name:string,symbol:string,address:string,category:string,chains:array<string>,url:string,tvl:double,gecko_id:string,audit_links:array<string>>>"
HACKS = "array<struct<date:long,name:string,classification:string,technique:string,amount:double,defillamaId:string>>"
PAIRS = "pairs array<struct<chainId:string,dexId:string,baseToken:struct<address:string,symbol:string,name:string>,priceUsd:string,liquidity:struct<usd:double>,volume:struct<h24:double>,info:struct<websites:array<struct<url:string>>,socials:array<struct<type:string,url:string>>>>>"
HOLDERS = "holders array<struct<address:string,balance:double,share:double>>"
FEED = "data struct<contents:array<struct<id:string,title:string,bodyTextOnly:string,date:long,username:string,viewCount:long>>>"
REDDIT = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,created_utc:double,score:long,num_comments:long,author:string>>>>"
REPO = "full_name string, stargazers_count long, forks_count long, open_issues_count long, pushed_at string, archived boolean"
#: Funding and open interest of each exchange: schema, and what is read of its rows.
EXCHANGES = {
    "binance": ("array<struct<symbol:string,lastFundingRate:string,openInterest:string>>", lambda r: (r["symbol"], r["lastFundingRate"], r["openInterest"])),
    "okx": ("data array<struct<instId:string,fundingRate:string,oiCcy:string>>", lambda r: (r["instId"], r["fundingRate"], r["oiCcy"])),
    "bybit": ("result struct<list:array<struct<symbol:string,fundingRate:string,openInterest:string>>>", lambda r: (r["symbol"], r["fundingRate"], r["openInterest"])),
    "bitget": ("data array<struct<symbol:string,fundingRate:string,holdingAmount:string>>", lambda r: (r["symbol"], r["fundingRate"], r["holdingAmount"])),
    "gate": ("array<struct<name:string,funding_rate:string,position_size:string>>", lambda r: (r["name"], r["funding_rate"], r["position_size"])),
}


def answers(landed: DataFrame, schema: str) -> DataFrame:
    """source, key, landed_at and a (the answer) of what can be read. landed: source, key, status, body, landed_at."""
    rows = landed.filter(F.coalesce(F.col("status"), F.lit(200)) == 200).withColumn("a", F.from_json("body", schema))
    return rows.select("source", "key", "landed_at", "a").filter("a is not null")


def degraded(landed: DataFrame) -> DataFrame:
    """source, key and reason of answers that hold no rows: refused (403, 429), failed (other codes), or no JSON or XML; callers go on without them."""
    body = F.trim(F.coalesce("body", F.lit("")))
    reason = F.when(F.col("status").isin(403, 429), "refused").when(F.coalesce(F.col("status"), F.lit(200)) != 200, "failed").when(~body.rlike(r"^[\[{<]"), "unreadable")
    return landed.select("source", "key", reason.alias("reason")).filter("reason is not null")


def listing(landed: DataFrame) -> DataFrame:
    """The map of active assets: source_id, symbol, name, slug, rank and contract."""
    rows = answers(landed, MAP).select(F.explode("a.data").alias("r")).filter("r.is_active = 1 and r.id is not null")
    return rows.select(F.col("r.id").cast("string").alias("source_id"), "r.symbol", "r.name", "r.slug", "r.rank", normal_address(F.col("r.platform.token_address")).alias("contract"))


def quotes(landed: DataFrame) -> DataFrame:
    """The eight fields of a snapshot: source_id, price_usd, market_cap, fdv, volume_24h, change_24h, change_7d (shares), circulating_supply, total_supply and ts."""
    rows = answers(landed, QUOTES).select("landed_at", F.explode("a.data").alias("k", "r")).filter("r.quote.USD.price is not null")
    u = lambda c: F.col(f"r.quote.USD.{c}")
    return rows.select(
        F.col("r.id").cast("string").alias("source_id"), u("price").alias("price_usd"), u("market_cap").alias("market_cap"), u("fully_diluted_market_cap").alias("fdv"), u("volume_24h").alias("volume_24h"),
        (u("percent_change_24h") / 100).alias("change_24h"), (u("percent_change_7d") / 100).alias("change_7d"), F.col("r.circulating_supply").alias("circulating_supply"), F.col("r.total_supply").alias("total_supply"),
        F.coalesce(F.try_to_timestamp(u("last_updated")), F.col("landed_at")).alias("ts"),
    )


def coin_links(landed: DataFrame) -> DataFrame:
    """source_id, url_key and url of a coin's own links, each once; empty ones are none."""
    rows = answers(landed, COIN)
    pair = lambda key, urls: F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.struct(F.lit(key).alias("url_key"), u.alias("url")))
    l = lambda c: F.col(f"a.links.{c}")
    every = F.concat(pair("website", l("homepage")), pair("technical_doc", F.array(l("whitepaper"))), pair("source_code", l("repos_url.github")), pair("message_board", F.array(l("subreddit_url"))))
    return rows.select(F.col("a.id").alias("source_id"), F.inline(every)).filter("url <> ''").distinct()


def coin_contracts(landed: DataFrame) -> DataFrame:
    """source_id, symbol, name, chain and contract: a row for each chain that a coin is on."""
    rows = answers(landed, COIN).select("a.id", "a.symbol", "a.name", F.explode("a.platforms").alias("chain", "contract")).filter("contract <> ''")
    return rows.select(F.col("id").alias("source_id"), "symbol", "name", "chain", normal_address(F.col("contract")).alias("contract"))


def protocols(landed: DataFrame) -> DataFrame:
    """protocol_id, symbol, name, contract, category, chains, url, tvl, coin (id at another source) and audit_links; a dash is no symbol, the chain is cut off an address."""
    r = lambda c: F.col(f"r.{c}")
    rows = answers(landed, PROTOCOLS).select(F.explode("a").alias("r")).filter("r.id is not null")
    contract = normal_address(F.regexp_extract(r("address"), "([^:]+)$", 1))
    return rows.select(r("id").alias("protocol_id"), F.nullif(r("symbol"), F.lit("-")).alias("symbol"), r("name"), F.nullif(contract, F.lit("")).alias("contract"), r("category"), r("chains"), r("url"), r("tvl"), r("gecko_id").alias("coin"), r("audit_links"))


def hacks(landed: DataFrame) -> DataFrame:
    """protocol_id, name, day, classification, technique and amount (USD; given in millions); those of no protocol are skipped."""
    rows = answers(landed, HACKS).select(F.explode("a").alias("r")).filter("r.defillamaId is not null")
    return rows.select(F.col("r.defillamaId").alias("protocol_id"), "r.name", F.to_date(F.timestamp_seconds("r.date")).alias("day"), "r.classification", "r.technique", (F.col("r.amount") * 1e6).alias("amount"))


def pairs(landed: DataFrame) -> DataFrame:
    """chain, contract, symbol, price_usd, liquidity, volume_24h, websites and socials of each token's pair with the greatest liquidity."""
    r = lambda c: F.col(f"r.{c}")
    rows = answers(landed, PAIRS).select(F.explode("a.pairs").alias("r")).withColumn("contract", normal_address(r("baseToken.address"))).filter("contract is not null")
    best = rows.groupBy(r("chainId").alias("chain"), "contract").agg(F.max_by("r", F.struct(F.coalesce(r("liquidity.usd"), F.lit(-1.0)), r("dexId"))).alias("r"))
    return best.select("chain", "contract", r("baseToken.symbol").alias("symbol"), r("priceUsd").try_cast("double").alias("price_usd"), r("liquidity.usd").alias("liquidity"), r("volume.h24").alias("volume_24h"),
                       F.transform(r("info.websites"), lambda w: w["url"]).alias("websites"), r("info.socials").alias("socials"))


def holders(landed: DataFrame) -> DataFrame:
    """contract (the key), rank, address, balance and share (of 1)."""
    rows = answers(landed, HOLDERS).select(F.col("key").alias("contract"), F.posexplode("a.holders").alias("n", "r")).filter("r.address is not null")
    return rows.select("contract", (F.col("n") + 1).alias("rank"), normal_address(F.col("r.address")).alias("address"), F.col("r.balance").alias("balance"), (F.col("r.share") / 100).alias("share"))


def funding(landed: DataFrame) -> DataFrame:
    """exchange, symbol, base, funding and oi of every exchange's answer; an exchange that fails takes no part. source: the exchange."""
    out = None
    for name, (schema, of) in EXCHANGES.items():
        rows = answers(landed.filter(F.col("source") == name), schema)
        at = F.col("a") if schema.startswith("array") else F.col("a.result.list") if name == "bybit" else F.col("a.data")
        symbol, rate, oi = of(F.col("r"))
        part = rows.select(F.explode(at).alias("r")).select(F.lit(name).alias("exchange"), symbol.alias("symbol"), rate.try_cast("double").alias("funding"), oi.try_cast("double").alias("oi"))
        out = part if out is None else out.unionByName(part)
    base = F.regexp_replace(F.regexp_replace(F.upper("symbol"), "[-_](SWAP|UMCBL)$", ""), "[-_/]?(USDT|USDC|USD)$", "")
    return out.filter("symbol is not null").withColumn("base", base)


def posts(landed: DataFrame) -> DataFrame:
    """author (the key), post_id, ts, text and views of a feed's answers, or of the data that its page carries; a post once."""
    inside = F.regexp_extract("body", r"(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1)
    page = F.col("body").rlike(r"^\s*<")
    body = F.when(page, F.get_json_object(inside, "$.props.pageProps")).otherwise(F.col("body"))
    rows = answers(landed.withColumn("body", body), FEED).select("key", F.explode("a.data.contents").alias("r")).filter("r.id is not null")
    text = F.trim(F.concat_ws("\n", F.nullif(F.col("r.title"), F.lit("")), "r.bodyTextOnly"))
    rows = rows.select(F.coalesce("r.username", "key").alias("author"), F.col("r.id").alias("post_id"), F.timestamp_millis("r.date").alias("ts"), text.alias("text"), F.col("r.viewCount").alias("views"))
    return rows.groupBy("author", "post_id").agg(F.max_by(F.struct("ts", "text", "views"), F.struct("views", "text")).alias("x")).select("author", "post_id", "x.*")


def discussions(landed: DataFrame) -> DataFrame:
    """asset (the key), post_id, ts, title, score and comments of a forum's listing."""
    rows = answers(landed, REDDIT).select("key", F.explode("a.data.children").alias("r")).filter("r.data.id is not null")
    return rows.select(F.col("key").alias("asset"), F.col("r.data.id").alias("post_id"), F.timestamp_seconds("r.data.created_utc").alias("ts"), "r.data.title", "r.data.score", F.col("r.data.num_comments").alias("comments"))


def news(landed: DataFrame) -> DataFrame:
    """asset (the key), title, url and ts of the items of an RSS answer; a body that is no XML has none."""
    rows = landed.filter((F.coalesce(F.col("status"), F.lit(200)) == 200) & F.col("body").rlike(r"^\s*<(\?xml|rss)")).select("key", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("i"))

    def field(name: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract("i", rf"(?s)<{name}>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
        for sign, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
            raw = F.replace(raw, F.lit(code), F.lit(sign))
        return F.nullif(F.trim(raw), F.lit(""))

    ts = F.try_to_timestamp(F.regexp_extract(field("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return rows.select(F.col("key").alias("asset"), field("title").alias("title"), field("link").alias("url"), ts.alias("ts")).filter("title is not null")


def repositories(landed: DataFrame) -> DataFrame:
    """repository, stars, forks, issues and pushed_at; archived ones too."""
    rows = answers(landed, REPO).filter("a.full_name is not null")
    return rows.select(F.col("a.full_name").alias("repository"), F.col("a.stargazers_count").alias("stars"), F.col("a.forks_count").alias("forks"), F.col("a.open_issues_count").alias("issues"), F.try_to_timestamp("a.pushed_at").alias("pushed_at"), F.col("a.archived").alias("archived"))


#: What each kind of landed answer becomes.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "listing": listing, "quotes": quotes, "coin_links": coin_links, "coin_contracts": coin_contracts, "protocols": protocols, "hacks": hacks, "pairs": pairs, "holders": holders, "funding": funding,
    "posts": posts, "discussions": discussions, "news": news, "repositories": repositories,
}

"""Every landed answer by a small one of its shape."""

import datetime
import json

import pytest

from marlstone.sources import payloads

T = datetime.datetime(2024, 5, 1)
SCHEMA = "source string, key string, status int, body string, landed_at timestamp"

NEXT = '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"data":{"contents":[{"id":"9","bodyTextOnly":"from page","date":1714521600000,"username":"bob","viewCount":1}]}}}}</script></html>'
RSS = "<?xml version='1.0'?><rss><channel><title>c</title><item><title><![CDATA[A & B]]></title><link>https://n/1</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate></item><item><title>x &lt;y&gt; &amp;amp;</title><link>https://n/2</link></item></channel></rss>"
BODIES = {
    "listing": [("cmc", "map", {"data": [{"id": 1, "name": "Bitcoin", "symbol": "BTC", "slug": "bitcoin", "rank": 1, "is_active": 1, "platform": None}, {"id": 2, "name": "T", "symbol": "T", "slug": "t", "rank": 9, "is_active": 1, "platform": {"symbol": "ETH", "token_address": "0xAB"}}, {"id": 3, "is_active": 0}]})],
    "quotes": [("cmc", "q", {"data": {"1": {"id": 1, "symbol": "BTC", "circulating_supply": 19.5, "total_supply": 21.0, "quote": {"USD": {"price": 2.0, "market_cap": 39.0, "fully_diluted_market_cap": 42.0, "volume_24h": 5.0, "percent_change_24h": -10.0, "percent_change_7d": 50.0, "last_updated": "2024-05-01T10:00:00Z"}}}, "2": {"id": 2, "quote": {"USD": {"price": None}}}}})],
    "coin_links": [("cg", "x", {"id": "uni", "symbol": "uni", "name": "Uniswap", "links": {"homepage": ["https://u", "", "https://u"], "whitepaper": "https://w", "repos_url": {"github": ["https://g"]}, "subreddit_url": None}})],
    "coin_contracts": [("cg", "x", {"id": "uni", "symbol": "uni", "name": "Uniswap", "platforms": {"ethereum": "0xAB", "solana": "SoL1", "": ""}})],
    "protocols": [("dl", "p", [{"id": "7", "name": "P", "symbol": "-", "address": "bsc:0xAB", "category": "Dex", "chains": ["BSC"], "url": "u", "tvl": 3.5, "gecko_id": "pp", "audit_links": ["a"]}, {"id": "8", "name": "Q", "symbol": "Q", "address": None}, {"name": "no id"}])],
    "hacks": [("dl", "h", [{"date": 1714521600, "name": "P", "classification": "c", "technique": "t", "amount": 2.5, "defillamaId": "7"}, {"date": 1, "name": "none", "defillamaId": None}])],
    "pairs": [("ds", "t", {"pairs": [{"chainId": "bsc", "dexId": "a", "baseToken": {"address": "0xAB", "symbol": "T", "name": "T"}, "priceUsd": "1.5", "liquidity": {"usd": 10.0}, "volume": {"h24": 1.0}, "info": {"websites": [{"url": "https://t"}], "socials": [{"type": "twitter", "url": "https://x"}]}}, {"chainId": "bsc", "dexId": "b", "baseToken": {"address": "0xab", "symbol": "T"}, "priceUsd": "9", "liquidity": None}, {"chainId": "bsc", "baseToken": None}]})],
    "holders": [("eth", "0xc", {"holders": [{"address": "0xAA", "balance": 5.0, "share": 50.0}, {"address": None}, {"address": "0xBB", "balance": 1.0, "share": 10.0}]})],
    "funding": [("binance", "f", [{"symbol": "BTCUSDT", "lastFundingRate": "0.0001", "openInterest": "5"}]), ("okx", "f", {"data": [{"instId": "BTC-USDT-SWAP", "fundingRate": "0.0002", "oiCcy": "6"}]}), ("bybit", "f", {"result": {"list": [{"symbol": "BTCUSDT", "fundingRate": "", "openInterest": "7"}]}}), ("bitget", "f", {"data": [{"symbol": "BTCUSDT_UMCBL", "fundingRate": "0.0003", "holdingAmount": "8"}]}), ("gate", "f", [{"name": "BTC_USDT", "funding_rate": "-0.0001", "position_size": "9"}])],
    "posts": [("sq", "ann", {"data": {"contents": [{"id": "1", "title": "T", "bodyTextOnly": "b", "date": 1714521600000, "viewCount": 2}, {"id": "1", "title": "T", "bodyTextOnly": "b", "date": 1714521600000, "viewCount": 5}, {"id": None}]}}), ("sq", "bob", NEXT)],
    "discussions": [("reddit", "BTC", {"data": {"children": [{"data": {"id": "a1", "title": "hi", "selftext": "", "created_utc": 1714521600.0, "score": 3, "num_comments": 4}}, {"data": None}]}})],
    "news": [("gn", "BTC", RSS)],
    "repositories": [("gh", "r", {"full_name": "a/b", "stargazers_count": 5, "forks_count": 2, "open_issues_count": 1, "pushed_at": "2024-05-01T00:00:00Z", "archived": False})],
}
WANT = {
    "listing": [("1", "BTC", "Bitcoin", "bitcoin", 1, None), ("2", "T", "T", "t", 9, "0xab")],
    "quotes": [("1", 2.0, 39.0, 42.0, 5.0, -0.1, 0.5, 19.5, 21.0, datetime.datetime(2024, 5, 1, 10))],
    "coin_links": [("uni", "source_code", "https://g"), ("uni", "technical_doc", "https://w"), ("uni", "website", "https://u")],
    "coin_contracts": [("uni", "uni", "Uniswap", "ethereum", "0xab"), ("uni", "uni", "Uniswap", "solana", "SoL1")],
    "protocols": [("7", None, "P", "0xab", "Dex", ["BSC"], "u", 3.5, "pp", ["a"]), ("8", "Q", "Q", None, None, None, None, None, None, None)],
    "hacks": [("7", "P", datetime.date(2024, 5, 1), "c", "t", 2.5e6)],
    "pairs": [("bsc", "0xab", "T", 1.5, 10.0, 1.0, ["https://t"], [("twitter", "https://x")])],
    "holders": [("0xc", 1, "0xaa", 5.0, 0.5), ("0xc", 3, "0xbb", 1.0, 0.1)],
    "funding": [("binance", "BTCUSDT", 0.0001, 5.0, "BTC"), ("bitget", "BTCUSDT_UMCBL", 0.0003, 8.0, "BTC"), ("bybit", "BTCUSDT", None, 7.0, "BTC"), ("gate", "BTC_USDT", -0.0001, 9.0, "BTC"), ("okx", "BTC-USDT-SWAP", 0.0002, 6.0, "BTC")],
    "posts": [("ann", "1", T, "T\nb", 5), ("bob", "9", T, "from page", 1)],
    "discussions": [("BTC", "a1", T, "hi", 3, 4)],
    "news": [("BTC", "A & B", "https://n/1", datetime.datetime(2024, 5, 1, 10)), ("BTC", "x <y> &amp;", "https://n/2", None)],
    "repositories": [("a/b", 5, 2, 1, T, False)],
}


def landed(spark, rows):
    return spark.createDataFrame([(s, k, status, b if b is None or isinstance(b, str) else json.dumps(b), T) for s, k, b, *rest in rows for status in (rest or [200])], SCHEMA)


@pytest.mark.parametrize("kind", sorted(payloads.PARSERS))
def test_rows_of(spark, kind):
    odd = [("cmc", "refused", BODIES[kind][0][2], 429), ("cmc", "null", None), ("cmc", "text", "not json"), ("binance", "empty", "{}")]
    rows = payloads.PARSERS[kind](landed(spark, BODIES[kind] + odd)).collect()
    plain = lambda x: tuple(map(plain, x)) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x
    assert sorted((tuple(map(plain, map(lambda x: tuple(x) if hasattr(x, "asDict") else [tuple(y) if hasattr(y, "asDict") else y for y in x] if isinstance(x, list) else x, r))) for r in rows), key=str) == sorted(WANT[kind], key=str)


def test_degraded(spark):
    rows = [("a", "ok", "{}"), ("a", "refused", "{}", 429), ("a", "forbidden", None, 403), ("a", "failed", "x", 500), ("a", "odd", "<"), ("a", "text", "oops"), ("a", "null", None)]
    got = {r.key: r.reason for r in payloads.degraded(landed(spark, rows)).collect()}
    assert got == {"refused": "refused", "forbidden": "refused", "failed": "failed", "text": "unreadable", "null": "unreadable"}

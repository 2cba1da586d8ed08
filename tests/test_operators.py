"""Limits, nulls and ties of single operators on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.functions import models
from marlstone.operators import components, crawl, dossier, entities, flows, intake, keyed, links, market, posts, research, selection
from marlstone.sources import landed

D = dt.date


def test_signal_limits(spark):
    rows = [(1, D(2024, 1, 1), 0.15, 2.0, 0.2, 0.0005, 0.05), (2, D(2024, 1, 1), -0.30, 5.0, -0.5, 0.00051, 0.2), (3, D(2024, 1, 1), None, 1.99, 0.1999, None, None)]
    df = spark.createDataFrame(rows, "asset_id long, trade_date date, price_change double, volume_ratio double, oi_change double, funding double, unlock_30d double")
    got = {(r.asset_id, r.signal): r.severity for r in market.asset_signals(df).collect()}
    names = ("price_change", "volume_ratio", "oi_change", "unlock_30d")
    assert got == {(1, n): "warning" for n in names} | {(2, n): "critical" for n in names} | {(2, "funding"): "warning"}


def test_volume_ratio_counts_calendar_days(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), 10), (1, D(2024, 1, 9), 20), (1, D(2024, 1, 10), 40)], "asset_id long, trade_date date, volume long")
    got = {r.trade_date.day: r.volume_ratio for r in market.volume_ratio(df).collect()}
    assert got == {1: None, 9: None, 10: 2.0}


def test_divergence_needs_three(spark):
    rows = [(65.0, 0.0, 0.0, -0.1, 0.0, 0.0, 1.0), (66.0, 0.2, 0.2, -0.1, 0.0, 0.0, 1.0), (66.0, 0.0, 0.2, -0.1, 0.0, 0.0, 1.0), (34.0, 0.0, 0.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "sentiment double, chg24 double, chg7 double, whale7 double, holders7 double, to_cex double, cap double")
    assert sorted((r.sentiment, r.direction, r.hits, r.severity) for r in market.divergence(df).collect()) == [(34.0, "bottom", 3, "medium"), (66.0, "top", 3, "medium")]


def test_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (1, 100, 101, 500, 501, 1000, 1001, None)], "rank int")
    got = [r[0] for r in df.select(market.tier(F.col("rank"))).collect()]
    assert got == ["top100", "top100", "top500", "top500", "top1000", "top1000", "other", "other"]


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0), (1, 6, 30.0)], "k long, rt long, v double")
    assert sorted(market.asof_join(left, right, "k", "t", "rt", ["v"]).collect()) == [(1, 1, None), (1, 5, 20.0), (2, 5, None)]


def test_netflow_turns_with_the_direction(spark):
    t = spark.createDataFrame([("a", "w", 5.0, dt.datetime(2024, 1, 2)), ("w", "b", 7.0, dt.datetime(2024, 1, 2)), ("w", "w", 1.0, dt.datetime(2024, 1, 2))], "from_address string, to_address string, usd double, ts timestamp_ntz")
    w = spark.createDataFrame([("w", "ex")], "address string, exchange string")
    as_of = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")
    turned = t.select(F.col("to_address").alias("from_address"), F.col("from_address").alias("to_address"), "usd", "ts")
    net = [flows.netflow(flows.with_direction(x, w), as_of, ["exchange"]).first().net_7d for x in (t, turned)]
    assert net == [2.0, -2.0]


def test_addresses_and_symbols(spark):
    left = spark.createDataFrame([(1, "AAA", "0xAB"), (2, "BBB", None), (3, "CCC", "Abc"), (4, "DDD", "0x1")], "id long, symbol string, contract string")
    right = spark.createDataFrame([(10, "XXX", "0xab"), (20, "bbb", None), (30, "zzz", "abc"), (40, "ddd", "0x2")], "id long, symbol string, contract string")
    assert sorted(entities.cross_match(left, right).collect()) == [(1, 10, "contract"), (2, 20, "symbol")]
    got = spark.createDataFrame([("btcusdt",), ("ETH-USD",), ("USDX",)], "s string").select(entities.base_symbol(F.col("s"))).collect()
    assert [r[0] for r in got] == ["BTC", "ETH", "USDX"]


def test_classification_cascade(spark):
    rows = [("https://github.com/x", "website"), ("https://a.io/x", "website"), ("https://a.io/white-paper", None), ("https://a.io/", None), (None, None)]
    got = spark.createDataFrame(rows, "u string, k string").select(links.classify(F.col("u"), F.col("k")).alias("c")).select("c.method", "c.confidence", F.array_join("c.topics", ",")).collect()
    assert [tuple(r) for r in got] == [("domain", 0.98, "other"), ("url_key", 0.9, "other"), ("keyword", 0.6, "whitepaper"), ("default", 0.3, "other"), ("default", 0.3, "other")]


def test_urls(spark):
    rows = [("HTTPS://WWW.A.io/B/?utm_source=x&y=1#top",), ("http://a.io/b?utm_a=1",), ("http://a.io",)]
    got = spark.createDataFrame(rows, "u string").select(links.normal_url(F.col("u")), links.host_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("https://www.a.io/B/?y=1", "a.io"), ("http://a.io/b", "a.io"), ("http://a.io", "a.io")]


def test_spa_limits(spark):
    rows = [("x" * 4999, 0), ("x" * 5000, 0), ("x" * 5000 + '<div id="root">', 0), ('<div id="root">', 1)]
    got = spark.createDataFrame(rows, "h string, n int").select(links.is_spa(F.col("h"), F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_noise_limits(spark):
    rows = [(1, "a")] * 5 + [(2, "a")] * 6 + [(3, "b")] * 101 + [(4, "b")] * 100 + [(3, "c")] * 11 + [(x, "d") for x in range(100, 151)]
    got = {(r.asset_id, r.host): r for r in links.noise(spark.createDataFrame(rows, "asset_id long, host string")).collect()}
    assert (got[1, "a"].dense, got[2, "a"].dense) == (False, True)
    assert (got[3, "b"].dominant, got[4, "b"].dominant) == (True, False)
    assert (got[100, "d"].shared, got[1, "a"].shared) == (True, False)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, v long, p string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], "k long, v long, p string")
    once = keyed.upsert(old, new, ["k"], [F.col("v")])
    assert sorted(once.collect()) == sorted(keyed.upsert(once, new, ["k"], [F.col("v")]).collect()) == [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]


def test_social_weights(spark):
    df = spark.createDataFrame([(100.0, 0.0, None, None), (None, None, None, None), (10.0, 10.0, 10.0, 10.0)], "community double, sentiment double, trend double, market double")
    got = [(r.score and round(r.score, 6), r.confidence) for r in research.social_composite(df).collect()]
    assert got == [(45.454545, "medium"), (None, "not_found"), (10.0, "high")]


def test_watch_limits(spark):
    day = D(2024, 1, 1)
    rows = [(1, "defi", day + dt.timedelta(14), 1.0, 1.0, None), (2, "defi", day + dt.timedelta(15), 1.0, 1.0, None), (3, "l2", day + dt.timedelta(21), 1.0, 1.0, None),
            (4, "meme", day, 1.0, 1.0, None), (5, "defi", day, 1.0, 0.5, "sent"), (6, "defi", None, 1.0, 0.8, None)]
    df = spark.createDataFrame(rows, "asset_id long, sector string, target_date date, entry_price double, last_price double, alert_sent string")
    out = research.watch_alerts(df, F.lit(day), entities.lead_days(F.col("sector")))
    assert sorted((r.asset_id, r.unlock_alert, r.drop_alert) for r in out.collect()) == [(1, True, False), (3, True, False), (6, False, True)]


def test_components_of_a_path_and_a_loop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100), (101, 102), (102, 101)], "u long, v long")
    got = dict(components.connected_components(edges).collect())
    assert got == {i: 0 for i in range(31)} | {101: 101, 102: 101}


def test_crawl_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = dict(crawl.crawl_fixpoint(spark.createDataFrame([("a",)], "url string"), edges).collect())
    assert got == {"a": 0, "b": 1, "c": 2}


def test_landed_responses(spark, tmp_path):
    rows = spark.createDataFrame([("cg", "1", dt.datetime(2024, 1, 1), '{"p": 1.5}'), ("cg", "1", dt.datetime(2024, 1, 2), '{"p": 2.5}'), ("dl", "2", dt.datetime(2024, 1, 1), "no json")], landed.RAW)
    landed.land(rows, str(tmp_path / "raw"))
    got = landed.parsed(landed.latest(landed.landed(spark, str(tmp_path / "raw"))), "p double")
    assert sorted((r.source, r.key, r.p) for r in got.collect()) == [("cg", "1", 2.5), ("dl", "2", None)]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://a/ </loc><lastmod>2024</lastmod></url><url><loc>http://b/</loc></url></urlset>")
    assert sorted(r.loc for r in landed.sitemap(spark, str(tmp_path / "s.xml")).collect()) == ["http://a/", "http://b/"]
    (tmp_path / "f.pdf").write_bytes(b"body")
    assert landed.files_as_text(spark, str(tmp_path / "f.pdf"), lambda b: b.decode()).first().snippet == "body"
    landed.register_feed(spark, "posts", lambda key: [{"id": f"{key}{i}"} for i in range(2)])
    assert spark.read.format("posts").option("keys", "a,b").load().count() == 4


def test_model_answers(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert [r.a for r in models.with_answers(df, "t", "a").collect()] == ["a b c", ""]
    got = spark.createDataFrame([(0.99, True), (0.1, False)], "c double, b boolean").select(models.clamped(F.col("c"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0.95, 0.5]


def test_append_version_counts_on(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "asset_id long, version int, thesis string")
    new = spark.createDataFrame([(1, "c"), (2, "d")], "asset_id long, thesis string")
    got = sorted(map(tuple, selection.append_version(old, new, "asset_id").collect()))
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")]


def test_reset_keeps_other_sources_and_nulls(spark):
    rows = [(1, "deep_crawl")] * 2 + [(1, None), (1, "api"), (2, "deep_crawl"), (None, "deep_crawl")]
    links_ = spark.createDataFrame(rows, "asset_id long, source string")
    got = sorted(map(tuple, selection.reset_crowded(links_, most=3).collect()), key=str)
    assert got == sorted([(1, None), (1, "api"), (2, "deep_crawl"), (None, "deep_crawl")], key=str)
    assert selection.next_page(links_, "asset_id", 1, 5).count() == 1


def test_priorities_of_sectors_and_gaps(spark):
    df = spark.createDataFrame([("l2",), ("ai",), ("meme",), ("defi",), (None,)], "sector string")
    assert [r[0] for r in df.select(selection.collect_priority(F.col("sector"))).collect()] == [95, 90, 45, 70, 70]
    rows = [("official_website", "l2"), ("audit", "l2"), ("docs", "l2"), ("unlocks", "l2"), ("docs", "other"), ("docs", None)]
    gaps = spark.createDataFrame(rows, "material string, sector string")
    got = gaps.select(selection.gap_rank(F.col("material"), F.col("sector"), {"l2": ["docs", "audit"]})).collect()
    assert [r[0] for r in got] == [0, 2, 1, 3, 3, 3]


def test_posts_name_assets(spark):
    assets = spark.createDataFrame([(2, "BTC"), (1, "BTC"), (3, "ETH")], "asset_id long, symbol string")
    aliases = spark.createDataFrame([("bitcoin", 1), ("btcusdt", 9)], "alias string, asset_id long")
    said = ["btc", "BITCOIN", "ETH-USDT", "BTCUSDT", "doge", None]
    rows = spark.createDataFrame(list(enumerate(said)), "post_id int, symbol string")
    got = [tuple(r) for r in posts.named_assets(rows, assets, aliases).orderBy("post_id").select("asset_id", "matched_by").collect()]
    assert got == [(1, "symbol"), (1, "alias"), (3, "pair"), (9, "alias"), (None, None), (None, None)]


def test_latest_of_ties_and_enriched(spark):
    rows = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (1, 4, 9.0)], "asset_id long, t int, v double")
    last = posts.latest(rows, "asset_id", ["t"], {"now": "v"})
    got = posts.enriched(spark.createDataFrame([(1,), (2,)], "asset_id long"), [last]).orderBy("asset_id").collect()
    assert [tuple(r) for r in got] == [(1, 3.0), (2, None)]


def test_visible_materials(spark):
    rows = [("github", "meme"), ("unlocks", "meme"), ("unlocks", "l2"), ("unlocks", None), ("audit", "defi"), ("audit", "l2"), ("audit", None)]
    df = spark.createDataFrame(rows, "m string, s string").select(dossier.visible(F.col("m"), F.col("s"), {"defi": ["audit"], "meme": ["unlocks"]}))
    assert [bool(r[0]) for r in df.collect()] == [True, False, True, True, True, False, False]
    assert len(dossier.MATERIALS) == len(set(dossier.MATERIALS)) == 21


def test_stages_of_classification(spark):
    schema = "link_id int, url string, url_key string, topics array<string>, method string, confidence double"
    rows = spark.createDataFrame([
        (1, "https://a.example/start", None, None, None, None), (2, "https://a.example/start", "technical_doc", None, None, None),
        (3, "https://a.example/x", None, ["team_vc"], "ai_content", 0.9), (4, "https://a.example/y", None, ["other"], "default", 0.3),
    ], schema)
    assert [r.link_id for r in intake.backlog(rows).orderBy("link_id").collect()] == [1, 2]
    filled = intake.backfill(rows)
    assert sorted(r.link_id for r in intake.low_confidence(filled).collect()) == [1, 4]
    answers = spark.createDataFrame([(1, ["docs"], 0.85, "guide")], "link_id int, ai_topics array<string>, ai_confidence double, reason string")
    got = {r.link_id: (r.method, r.confidence, r.topics, r.needs_browser) for r in intake.read_bodies(filled, answers).collect()}
    assert got[1] == ("ai_content", 0.85, ["docs"], False) and got[2][:2] == ("url_key", 0.9)
    assert got[3] == ("ai_content", 0.9, ["team_vc"], False) and got[4] == ("ai_failed", 0.3, ["other"], True)


def test_third_party_details(spark):
    bodies = [("p", '{"audit_links": ["u", "u", null], "raises": [{"round": "seed", "amount": 2}, {"round": "a"}], "hacks": []}'), ("q", "broken"), ("r", "{}")]
    details = spark.createDataFrame(bodies, "protocol_id string, body string")
    rows = intake.mapped(details, spark.createDataFrame([("p", 1), ("q", 2)], "protocol_id string, asset_id long"))
    assert [tuple(r) for r in intake.audit_links(rows).collect()] == [(1, "u", "audit")]
    assert [tuple(r) for r in intake.raises(rows).collect()] == [(1, 2, 2.0)]
    assert intake.hacks(rows).count() == 0


def test_search_inserts_only_what_core_misses(spark):
    schema = "asset_id long, symbol string, name string, contract string"
    core = spark.createDataFrame([(1, "BTC", "bitcoin", None)], schema)
    listing = spark.createDataFrame([(2, "BTC2", "other", None), (3, "DOGE", "doge", None)], schema)
    assert [(r.asset_id, r.inserted) for r in intake.found_or_listed(core, listing, "btc").collect()] == [(1, False)]
    assert [(r.asset_id, r.inserted) for r in intake.found_or_listed(core, listing, "doge").collect()] == [(3, True)]


def test_links_that_are_left_out(spark):
    rows = spark.createDataFrame([("u/a.PDF?x=1", "docs"), ("u/a", "twitter"), ("u/pdf", None)], "url string, kind string")
    assert sorted(r.url for r in intake.for_curation(rows).collect()) == ["u/a.PDF?x=1", "u/pdf"]
    assert sorted(r.url for r in intake.pages_only(rows).collect()) == ["u/a", "u/pdf"]
    got = spark.createDataFrame([("docs",), ("official_website",), ("audit",), (None,)], "m string").select(intake.crawl_rank(F.col("m"))).collect()
    assert [r[0] for r in got] == [2, 1, 3, 3]
    assert spark.range(1).select(intake.short_origin(F.repeat(F.lit("x"), F.lit(99)))).first()[0] == "x" * 64


def test_topics_of_links(spark):
    rows = spark.createDataFrame([(1, ["team_vc", "other"]), (1, ["team_vc", "research"]), (2, None)], "asset_id long, topics array<string>")
    assert sorted(map(tuple, dossier.materials_of_topics(rows).collect())) == [(1, "competitors"), (1, "team_vc")]
    assert [r[0] for r in rows.select(dossier.has_any(F.col("topics"), ["research"])).collect()] == [False, True, False]

"""Noise by layers, gaps filled in rounds, evidence, unlock sources, derivatives and competitors against plain forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import derivatives, dossier, fill, intake, links
from marlstone.plans import upkeep_queries
from marlstone.plans.catalogue import QUERIES

DAY = datetime.date(2024, 1, 1)


def test_noise_layers(spark):
    rows = [(1, "agg", "https://agg/1", "uni", None), (1, None, None, None, None), (1, "bad", "https://bad", None, None), (1, "audit", "https://audit/one", None, "Swap x")]
    rows += [(2, "audit", f"https://audit/{'swap' if i < 2 else 'z'}{i}", None, "Swap") for i in range(7)]
    rows += [(3, "big", "https://big", None, None)] * 101 + [(3, "small", "https://small", None, None)]
    rows += [(10 + i, "wide", "https://wide", None, None) for i in range(51)] + [(4, "judged", "https://judged", None, None), (4, "both", "https://both", None, None)]
    df = spark.createDataFrame(rows, "asset_id long, host string, url string, symbol string, name string").withColumns({c: F.lit(1) for c in ("dense", "assets", "_noise_")})
    verdicts = spark.createDataFrame([(3, "big"), (3, "small"), (4, "judged"), (4, "judged"), (1, "audit"), *[(10 + i, "wide") for i in range(51)]], "asset_id long, host string")
    out = links.cleaned(df.drop("dense", "assets"), verdicts, ["agg"], ["bad", "both"], ["audit", "both"])
    assert out.count() == len(rows)
    got = {(r.asset_id, r.host, r.url): (r.layer, r.kept) for r in out.collect()}
    of = lambda a, h: {v for (x, y, _), v in got.items() if (x, y) == (a, h)}
    assert of(1, "agg") == {("aggregator", False)} and of(1, "bad") == {("rule", False)} and of(1, None) == {("kept", True)} and of(1, "audit") == {("audit", True)}
    assert sum(v == ("crowd", False) for (x, _, _), v in got.items() if x == 2) == 5 and sum(v == ("kept", True) for (x, _, _), v in got.items() if x == 2) == 2
    assert of(3, "big") == {("reset", True)} and of(3, "small") == {("model", False)} and of(4, "judged") == {("model", False)} and of(4, "both") == {("kept", True)}
    assert {v for (x, *_), v in got.items() if x >= 10} == {("shared", True)}


def test_fill_plan_covers_every_material(spark):
    assert set(fill.FILLED_BY) == set(dossier.MATERIALS) and {a for x in fill.FILLED_BY.values() for a in x} == set(fill.ORDER)
    gaps = spark.createDataFrame([(1, "audit"), (1, "roadmap"), (2, "unlocks")], "asset_id long, material string")
    got = {(r.asset_id, r.step, r.action): r.materials for r in fill.plan(gaps).collect()}
    assert got == {(1, 1, "deep"): ["audit", "roadmap"], (1, 2, "spa"): ["roadmap"], (1, 3, "third_party"): ["audit"], (1, 6, "ai_classify"): ["roadmap"], (2, 10, "unlocks"): ["unlocks"]}


def test_fill_until_done(spark):
    assets = spark.createDataFrame([(i,) for i in range(4)] + [(0,)], "asset_id long")
    have = spark.createDataFrame([(0, m) for m in dossier.MATERIALS] + [(1, "audit")], "asset_id long, material string")
    calls = []

    def deep(targets, number):
        calls.append(number)
        every = spark.createDataFrame([(1, "whitepaper", 1), (1, "github", 2), (2, "whitepaper", 3), (2, "whitepaper", 4), (9, "github", 1), (2, "unlocks", 1)], "asset_id long, material string, n int")
        return every.filter(F.col("n") <= number).drop("n")

    def down(targets, number):
        raise TimeoutError("slow")

    out, report = fill.fill_until_done(assets, have, {"deep": deep, "holders": down})
    got = sorted(map(tuple, out.filter("asset_id > 0").collect()))
    assert got == [(1, "audit"), (1, "github"), (1, "whitepaper"), (2, "whitepaper")] and calls == [1, 2, 3, 4]
    rows = [tuple(r) for r in report.orderBy("round", "action").collect()]
    assert [(r[0], r[1], r[3]) for r in rows] == [(1, "deep", 1), (1, "holders", 0), (2, "deep", 1), (2, "holders", 0), (3, "deep", 1), (3, "holders", 0), (4, "deep", 0), (4, "holders", 0)]
    assert all(("TimeoutError" in r[5]) == (r[1] == "holders") if r[5] else r[1] == "deep" for r in rows) and rows[-1][4] == 3 * 21 - 4
    calls.clear()
    assert fill.fill_until_done(assets, have, {"deep": deep}, least_pending=500)[1].count() == 0 and not calls
    assert fill.fill_until_done(assets, have, {"deep": deep}, rounds=2)[0].count() == 21 + 3
    late = fill.fill_until_done(assets, have, {"deep": deep}, seconds=-1.0)[1].collect()
    assert [r.error for r in late] == ["round out of time"]


def test_a_failed_fill_is_no_result(spark, monkeypatch):
    """A source that is down in the last round, one that has not run and rounds that end too early are told; other failures are raised at once."""
    assets, have = spark.createDataFrame([(1,), (2,)], "asset_id long"), spark.createDataFrame([], "asset_id long, material string")
    one = spark.createDataFrame([(1, "github", 1), (2, "github", 2)], "asset_id long, material string, n int")
    found = lambda targets, number: one.filter(F.col("n") <= number)

    def down(until):
        def action(targets, number):
            if number <= until:
                raise ConnectionError("no answer")
            return found(targets, number)

        return action

    def wrong(targets, number):
        raise ValueError("a fault of ours")

    lazy = lambda targets, number: targets.select("asset_id", F.raise_error(F.lit("lost")).cast("string").alias("material"))
    fills = lambda actions, **limits: fill.fill_until_done(assets, have, actions, **limits)
    for failing, error in ((wrong, ValueError), (lazy, Exception)):
        with pytest.raises(error):
            fills({"deep": failing})
    for actions, limits, told in (({"deep": found, "holders": down(99)}, {}, "no answer"), ({"deep": found}, {"seconds": -1.0}, "out of time"), ({"deep": found}, {"rounds": 1}, "still closed")):
        with pytest.raises(fill.Unfinished, match=told):
            fill.whole(*fills(actions, **limits))
    assert sorted(map(tuple, fill.whole(*fills({"deep": found, "holders": down(1)}))[0].collect())) == [(1, "github"), (2, "github")]
    assert fill.whole(*fills({"deep": found}, least_pending=500))[1].count() == 0
    for name in ("fill_rounds", "materials_filled"):
        monkeypatch.setattr(upkeep_queries, "actions", lambda spark, d: {"deep": down(99)})
        with pytest.raises(fill.Unfinished):
            QUERIES[name](spark, "/root/testdata/sf0.001")


def test_evidence_and_unlock_source(spark):
    rows = [(1, 1, "audit", DAY), (1, 2, "other", DAY), (1, 3, "whitepaper", None), (1, 4, "whitepaper", DAY), (1, 5, None, DAY + datetime.timedelta(days=9)), (1, 6, "audit", DAY + datetime.timedelta(days=1))]
    df = spark.createDataFrame(rows, "asset_id long, doc_id long, kind string, published_at date")
    assert [r.doc_id for r in dossier.evidence(df, 5).orderBy("place").collect()] == [4, 3, 6, 1, 5]
    df = spark.createDataFrame([(1, True, False, 1.0, 1.0), (2, None, True, None, None), (3, False, None, 1.0, 2.0), (4, False, False, 1.0, None), (5, None, None, None, None)], "id long, c boolean, s boolean, price double, cap double")
    got = {r.id: (r.tier, r.missing) for r in intake.unlock_source(df, {"cache": F.col("c"), "site": F.col("s")}, ["price", "cap"]).collect()}
    assert got == {1: ("cache", []), 2: ("site", []), 3: ("model", []), 4: ("refused", ["cap"]), 5: ("refused", ["price", "cap"])}


def test_read_bodies_keeps_confidence_in_its_band(spark):
    rows = spark.createDataFrame([(i, "default", 0.3, ["other"]) for i in range(4)], "link_id int, method string, confidence double, topics array<string>")
    answers = spark.createDataFrame([(0, ["a"], 0.99, "r", True), (1, ["a"], 0.1, "r", True), (2, ["a"], 0.99, "r", False), (3, ["a"], 0.6, "r", None)], "link_id int, ai_topics array<string>, ai_confidence double, reason string, has_body boolean")
    assert {r.link_id: r.confidence for r in intake.read_bodies(rows, answers).collect()} == {0: 0.95, 1: 0.8, 2: 0.7, 3: 0.6}


def test_derivatives(spark):
    rng = random.Random(1)
    data = [(a, e, DAY + datetime.timedelta(days=t), float(rng.randrange(0, 9)), rng.random() - 0.5, float(rng.randrange(5)), float(rng.randrange(5))) for a in range(3) for t in range(0, 60, a + 1) for e in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(data, "asset_id long, exchange long, day date, oi double, funding double, taker_buy double, taker_sell double")
    out = {r.asset_id: r for r in derivatives.answer(derivatives.by_day(df)).collect()}
    for a in range(3):
        days = {}
        for x, e, d, oi, f, b, s in data:
            if x == a:
                v = days.setdefault(d, [0, 0, 0, 0])
                v[0] += oi
                v[1] += oi * f
                v[2] += b
                v[3] += s
        last = max(days)
        ago = lambda n: next((days[d][0] for d in sorted(days, reverse=True) if (last - d).days >= n), None)  # noqa: B023, E731
        mean = lambda n: [days[d][1] / days[d][0] for d in days if (last - d).days < n and days[d][0]]  # noqa: B023, E731
        r, near = out[a], lambda x, y: (x is None and y is None) or abs(x - y) < 1e-9
        assert r.day == last and near(r.oi, days[last][0]) and near(r.funding_7d, sum(mean(7)) / len(mean(7))) and near(r.funding_30d, sum(mean(30)) / len(mean(30)))
        for n, c in ((1, r.oi_change_24h), (7, r.oi_change_7d)):
            assert near(c, days[last][0] / ago(n) - 1 if ago(n) else None)
        window = [days[d] for d in days if (last - d).days < 30]
        assert near(r.cvd, sum(v[2] - v[3] for v in window)) and near(r.long_short, sum(v[2] for v in window) / sum(v[3] for v in window))


def test_competitors_and_stance(spark):
    rows = [(i, i % 2, float(i % 7) if i % 5 else None) for i in range(30)] + [(99, None, 3.0)]
    df = spark.createDataFrame(rows, "asset_id long, sector long, volume double")
    got = {}
    for r in sorted(derivatives.competitors(df, "volume", 4).collect(), key=lambda r: r.position):
        got.setdefault(r.target, []).append(r.asset_id)
    for i, s, v in rows:
        rest = sorted((x for x in rows if s is not None and x[1] == s and x[0] != i), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        assert got[i] == [i, *[x[0] for x in rest[:3]]]
    signs = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", -1.0), (2, "b", 1.0), (3, "b", -0.5)], "asset_id long, part string, sign double")
    out = {r.asset_id: (r.stance, round(r.conviction, 6), r.parts) for r in derivatives.stance(signs, {"a": 0.5, "b": 0.5}).collect()}
    assert out == {1: ("bullish", 0.5, 1), 2: ("neutral", 0.0, 2), 3: ("bearish", 0.25, 1)}

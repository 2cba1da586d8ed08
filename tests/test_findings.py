"""What findings on larger tables showed, on small rows."""

import datetime as dt

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstone.operators import correlation, derivatives, flows, links, research, retrieval, skew
from marlstone.plans.catalogue import QUERIES
from marlstone.streaming import posts

D = dt.datetime


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")


def test_a_mean_at_the_limit_of_a_class_is_neutral_in_any_order_of_its_sum(spark, tmp_path):
    """These values have a mean of 65, but their sum in doubles in this order gives more."""
    values = [68.79, 30.75, 159.86, 0.6]
    written(spark, tmp_path, "events", [(i, D(2024, 1, 1), 1, "view", v, None) for i, v in enumerate(values)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    assert [tuple(r) for r in QUERIES["sentiment_distribution"](spark, str(tmp_path)).collect()] == [("neutral", 1)]


def test_a_search_sends_no_row_for_each_question_and_passage(spark):
    """Postings of a word of every question and passage are sent once, and blocks and sets of questions change no result."""
    words = [f"w{i}" for i in range(9)]
    texts = [(d, p, " ".join(["the"] + [words[(d * k + p) % 9] for k in range(1, 5)])) for d in range(40) for p in range(2)]
    index = retrieval.build_index(spark.createDataFrame(texts, "doc_id long, passage int, text string"), 2)
    asked = spark.createDataFrame([(q, f"The {words[q % 9]} {words[(q * 5 + 1) % 9]}") for q in range(30)], "question long, text string")
    whole = sorted(map(tuple, retrieval.search(index, asked, 4).collect()))
    assert len(whole) == 120 and whole == sorted(map(tuple, retrieval.search(index, asked, 4, block=7, most=4).collect()))
    plan = retrieval.search(index, asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [question" in line and "passage" in line for line in plan.splitlines())


def test_pairs_of_the_matrix_are_finished_where_they_are_made(spark, tmp_path):
    """Nothing is sent or sorted after the tiles are multiplied; tiles and blocks of any size give the same extremes and rows."""
    rng = np.random.default_rng(6)
    rows = [(a, D(2024, 1, 1) + dt.timedelta(days=t), float(rng.choice([0.0, 0.01, -0.02]))) for a in range(40) for t in range(14) if rng.random() < 0.9]
    series = spark.createDataFrame(rows, "asset_id long, trade_date timestamp, ret double")
    pairs = correlation.correlation_matrix(series, None, 10, digits=6)
    lines = [line.strip(" +-:") for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert "InArrow" in next(line for line in lines if not line.startswith("Project"))
    for tile, step in ((4096, 512), (9, 4)):
        sizes = {"tile": tile, "step": step}
        assert sorted(map(tuple, correlation.extremes(pairs.drop("days"), 5).collect())) == sorted(map(tuple, correlation.strongest(series, None, 10, 5, 6, **sizes).collect()))
        got = {r.asset_id: (r.cells, r.measured, round(r.total, 4)) for r in correlation.row_figures(series, None, 10, **sizes).collect()}
        want = {r.asset_id: (len(r.row), sum(x is not None for x in r.row.values()), round(sum(x for x in r.row.values() if x is not None), 4)) for r in correlation.matrix_rows(pairs).collect()}
        assert got == want


def test_an_author_costs_calls_to_the_state_by_batch_not_by_post():
    """A hundred posts of an author: one read, one write and one timer as they come, the same as they are due."""

    class State:
        value, calls = None, 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.value, self.calls = value, self.calls + 1

        def registerTimer(self, at):
            self.calls += 1

        deleteTimer = registerTimer

        def getCurrentWatermarkInMs(self):
            return 10**15

    state, processor = State(), posts.Posts(lambda texts, tried: [t if n else None for t, n in zip(texts, tried, strict=True)], 2, 1000)
    processor.init(state)
    rows = [Row(author=1, post_id=i, ts=D(2024, 1, 1), text=str(i)) for i in range(100)]
    assert list(processor.handleInputRows((1,), iter(rows + rows), state)) == [] and state.calls <= 4
    out = list(processor.handleExpiredTimer((1,), state, None))
    assert [(r.post_id, r.answer, r.ai_retry_count) for r in out] == [(i, str(i), 1) for i in range(100)] and state.calls <= 8
    assert list(processor.handleInputRows((1,), iter(rows), state)) == [] and state.value[2] == []


def test_links_of_a_hot_asset_and_host_stay_where_they_are(spark):
    """They are not gathered in one task; others, and those without host or asset, are judged as before."""
    name = F.lit(None).cast("string")
    rows = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 1000 == 1, 2).when(F.col("id") % 1000 != 2, 1).alias("asset_id").cast("long"), F.when(F.col("id") % 1000 != 3, F.lit("a.example")).alias("host"), F.lit("https://x").alias("url"), name.alias("symbol"), name.alias("name"))
    out = links.cleaned(rows, spark.createDataFrame([(1, "a.example")], "asset_id long, host string"), [], [], [])
    assert out.filter("layer = 'reset'").select(F.spark_partition_id()).distinct().count() >= 4
    assert {(r.layer, r.kept): r["count"] for r in out.groupBy("layer", "kept").count().collect()} == {("reset", True): 3988, ("kept", True): 12}


def test_gaps_are_found_without_a_broadcast(spark):
    """What the assets have grows with them, so it doesn't pass through the driver, however small it is."""
    have = spark.createDataFrame([(1, "docs")], "asset_id long, material string")
    gaps = research.missing(spark.createDataFrame([(1,), (2,)], "asset_id long"), have, ["docs", "audit"])
    assert "Broadcast" not in gaps._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, gaps.collect())) == [(1, "audit"), (2, "audit"), (2, "docs")]


def test_parts_meet_in_tasks_that_hold_none_of_their_sorts(spark):
    """Each part is made once and apart: what joins them ranks and sums nothing."""
    days = spark.createDataFrame([(a, D(2024, 1, 1 + t).date(), 1, 2.0 + a + t, 0.1, 1.0, 1.0) for a in range(5) for t in range(4)], "asset_id long, day date, exchange int, oi double, funding double, taker_buy double, taker_sell double")
    answers = [derivatives.answer(derivatives.by_day(days, parts)) for parts in (None, 3)]
    assert sorted(map(tuple, answers[0].collect())) == sorted(map(tuple, answers[1].collect()))
    out = derivatives.gathered(spark.range(6).withColumnRenamed("id", "asset_id"), {"own": answers[1].select("asset_id", "oi")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, out.collect())) == [(a, 5.0 + a, 1) for a in range(5)] + [(5, None, 0)]


def test_tasks_grow_with_the_rows_and_holders_are_the_same_in_any_number(spark):
    assert skew.tasks_for(spark.range(100), 5) == 20 and skew.tasks_for(spark.range(100), 50) == 8
    rng = np.random.default_rng(4)
    rows = [(int(a), None if h == 30 else int(h), float(x)) for a, h, x in zip(rng.choice([1, 1, 1, 2, 3], 600), rng.integers(0, 31, 600), rng.integers(0, 4, 600), strict=True)]
    moves = spark.createDataFrame(rows, "asset_id long, address long, amount double")
    whole = flows.concentration(moves.groupBy("asset_id", "address").agg(F.sum("amount").alias("balance")), ["asset_id"], (2, 5))
    for parts, deals in ((1, 1), (7, 3), (20, 40)):
        out = flows.concentration_of_moves(moves, ["asset_id"], parts, (2, 5), deals)
        assert out.columns == whole.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))

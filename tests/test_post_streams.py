"""Posts by a stateful stream: order, repeats, late ones, retries; and the join of two streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import research
from marlstone.storage import new_path
from marlstone.streaming import feeds, posts

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "author long, post_id long, ts timestamp, text string"
HOUR = 3_600_000


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def failing():
    """A model that fails as often as the text says; a local function, as workers can't import this file."""

    def model(texts, tried):
        return [t if n >= int(t) else None for t, n in zip(texts, tried, strict=True)]

    return model


FEED = [(a, 10 * a + i, at(4 * i + a), str((a + i) % 4)) for a in (1, 2, 3) for i in range(12)]


def plain(rows, closed, tries=2, delay=3):
    """What comes of each post by the time closed, in batch."""
    out = []
    for a, p, ts, text in set(rows):
        n = min(int(text), tries)
        if ts + datetime.timedelta(hours=delay * n) <= closed:
            out.append((a, p, None if int(text) > tries else text, int(text) > tries, n))
    return sorted(out)


def run(spark, batches):
    path, out, progress = new_path(spark, "feed"), new_path(spark, "out"), new_path(spark, "progress")
    with posts.rocks_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            feeds.run_to_end(posts.classified(feeds.read_feed(spark, path, spark.createDataFrame([], SCHEMA).schema, 100), failing(), "6 hours", 2, 3 * HOUR), progress, out=out)
    return sorted((r.author, r.post_id, r.answer, r.ai_failed, r.ai_retry_count) for r in spark.read.schema(posts.OUT).parquet(out).collect())


CLOSED = max(r[2] for r in FEED) - datetime.timedelta(hours=6)


def by_time(rows):
    return sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize("how", ["in order", "repeated", "disordered"])
def test_same_rows_as_batch(spark, how):
    rows = by_time(FEED)
    if how == "repeated":
        batches = [rows[:20], rows[:25], rows[10:], rows]
    elif how == "disordered":  # within what is allowed to be late
        batches = [[r for i, r in enumerate(rows) if (i + r[0]) // 6 == k] for k in range(8)]
        batches = [[r for r in reversed(b)] for b in batches if b]
    else:
        batches = [rows[:12], rows[12:]]
    assert run(spark, batches) == plain(FEED, CLOSED)


def test_late_and_null_posts_are_refused(spark):
    rows = by_time(FEED)
    late = [(1, 9, at(0.5), "0"), (1, 11, at(0.2), "0")]
    nulls = [(None, 500, at(50), "0"), (1, None, at(50), "0"), (1, 501, None, "0")]
    assert run(spark, [rows, late + nulls]) == plain(FEED, CLOSED)


def test_landed_posts_are_archived_matched_and_alerted_once(spark):
    path, progress, sent = new_path(spark, "feed"), new_path(spark, "progress"), []
    read = lambda b: b.select("author", "post_id", "ai_retry_count", F.lit("prediction").alias("kind"), F.when(F.col("answer") == "0", 0.9).otherwise(0.5).alias("confidence"))
    match = lambda s: s.withColumn("asset_id", F.col("author") * 100)
    sink = posts.Landed(spark, new_path(spark, "landed"), read, match, research.to_alert(F.col("kind"), F.lit(False), F.col("confidence")), lambda df: sent.extend(df.collect()))
    rows = by_time(FEED)
    with posts.rocks_state(spark):
        for batch in (rows[:15], rows):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
            feeds.run_to_end(posts.classified(feeds.read_feed(spark, path, spark.createDataFrame([], SCHEMA).schema, 100), failing(), "6 hours", 2, 3 * HOUR), progress, sink)
    want = plain(FEED, CLOSED)
    assert sorted((r.author, r.post_id, r.answer, r.ai_failed, r.ai_retry_count) for r in sink.archive().collect()) == want
    signals = sink.signals().collect()
    assert sorted(r.post_id for r in signals) == sorted(w[1] for w in want if not w[3])
    assert sorted(r.post_id for r in sent) == sorted(r.post_id for r in signals if r.is_alerted) == sorted(w[1] for w in want if w[2] == "0")


def test_interval_join(spark):
    left = [(i, i % 3, at(2 * i)) for i in range(40)] + [(99, 7, at(10)), (98, None, at(11))]
    right = [(i, i % 3, at(1.3 * i), float(i)) for i in range(60)]
    lp, rp, out, progress = (new_path(spark, x) for x in ("left", "right", "out", "progress"))
    ls, rs = "signal long, k long, lt timestamp", "fact long, k long, rt timestamp, v double"
    for half in (0, 1):
        spark.createDataFrame([r for r in left if (r[2] >= at(40)) == half], ls).coalesce(1).write.mode("append").parquet(lp)
        spark.createDataFrame([r for r in right if (r[2] >= at(40)) == half], rs).coalesce(1).write.mode("append").parquet(rp)
        streams = [feeds.read_feed(spark, p, spark.createDataFrame([], s).schema, 100) for p, s in ((lp, ls), (rp, rs))]
        feeds.run_to_end(feeds.interval_joined(*streams, "k", "lt", "rt", "5 hours", "1 hours", "3 hours"), progress, out=out)
    closed = at(60)
    want = set()
    for i, k, t in left:
        if t <= closed:
            hits = [f for f, kk, u, _ in right if k == kk and t - datetime.timedelta(hours=5) <= u <= t + datetime.timedelta(hours=1)]
            want |= {(i, f) for f in hits or [None]}
    rows = spark.read.schema("signal long, lt timestamp, k long, fact long, rt timestamp, v double").parquet(out)
    assert {(r.signal, r.fact) for r in rows.filter(F.col("lt") <= F.lit(closed)).collect()} == want

"""Queries that run a stream over the landed files to its end, or a loop to its fixpoint."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marlstone.operators import links, research
from marlstone.operators import posts as authors
from marlstone.operators.crawl import crawl_fixpoint as crawl
from marlstone.plans.bindings import DAILY
from marlstone.plans.link_queries import LINKS, NORMAL, found
from marlstone.plans.registry import query
from marlstone.sources.tables import table
from marlstone.storage import new_path
from marlstone.streaming import feeds
from marlstone.streaming import posts as streamed


def landed(spark, d, name: str, parts: int, by: str):
    """A table as parts that arrive one after the other; rows without a key come with the first."""
    path, df = new_path(spark, f"landed-{name}"), table(spark, d, name)
    for i in range(parts):
        df.filter(F.coalesce(F.col(by) % parts, F.lit(0)) == i).write.mode("append").parquet(path)
    return path, df.schema


def in_time(spark, d, parts: int, out: str | None, stream, each=None):
    """Runs a stream over the events that land in parts of time, from its checkpoint after each part."""
    path, progress, df = new_path(spark, "landed-in-time"), new_path(spark, "progress"), table(spark, d, "events")
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / parts if first else None
    for i in range(parts if first else 0):
        t = F.col("ts")
        part = df.filter((t >= first + i * step) & (t < first + (i + 1) * step) if i < parts - 1 else t >= first + i * step)
        part.write.mode("append").parquet(path)
        # All files of a part are one batch, so none of its rows is late.
        feeds.run_to_end(stream(feeds.read_feed(spark, path, df.schema, files_each=1_000_000)), progress, each, out)


def as_quotes(rows):
    return rows.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("asset_id"), "ts", F.col("value").alias("price"))


@query(f"with {DAILY} select * from daily where trade_date + 2 <= (select max(ts) from events)", date="trade_date")
def stream_daily_snapshot(spark, d):
    """Days that end a day before the last quote are complete."""
    out = new_path(spark, "snapshots")
    in_time(spark, d, 3, out, lambda rows: feeds.daily_snapshots(as_quotes(rows)))
    return spark.read.schema("asset_id bigint, trade_date date, price double, volume bigint").parquet(out)


@query("""with w as (select event_type, date_trunc('day', ts) - to_days(cast(k as int)) as start, value from events, range(7) r(k))
select event_type, start, round(sum(value), 4) as total, count(*) as n from w where start + interval 8 day <= (select max(ts) from events) group by 1, 2""", date="start")
def stream_rolling(spark, d):
    """Sums over seven days, each day, of every window that is complete."""
    out = new_path(spark, "rolling")
    in_time(spark, d, 3, out, lambda rows: feeds.rolling(rows, "value", ["event_type"]))
    rows = spark.read.schema("event_type string, start timestamp, total double, n bigint").parquet(out)
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 4).alias("total"), "n")


@query("select event_type, user_id, min(event_id) as event_id from (select event_id % 5000 as event_id, event_type, user_id from events) group by 1, 2")
def stream_dedup(spark, d):
    path, schema = landed(spark, d, "events", 3, "event_id")
    rows = feeds.read_feed(spark, path, schema).withColumn("event_id", F.col("event_id") % 5000)
    out = new_path(spark, "deduplicated")
    feeds.run_to_end(feeds.deduplicated(rows, ["event_id", "event_type", "user_id"], "ts", "60 days"), new_path(spark, "progress"), out=out)
    return spark.read.parquet(out).groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))


@query("select user_id, count(*) > 0 as alerted from events where value > 200 group by 1")
def stream_alert_once(spark, d):
    path, schema = landed(spark, d, "events", 3, "event_id")
    rows = feeds.read_feed(spark, path, schema).filter("value > 200").select("user_id", F.lit(True).alias("alerted"))
    sink = feeds.AlertOnce(spark, new_path(spark, "alerts"), rows.schema)
    feeds.run_to_end(feeds.first_of_each(rows, ["user_id"]), new_path(spark, "progress"), sink)
    return sink.sent().select("user_id", "alerted")


@query("""with p as (select conv_id, turn, (['prediction', 'analysis', 'after_action'])[turn % 3 + 1] as model, conv_id % 5 = 0 as entered, length(text) % 7 = 0 as pnl, (length(text) % 11) / 10 as confidence from conversations)
select conv_id, turn, confidence from p where model = 'prediction' and not entered and not pnl and confidence >= 0.8""")
def stream_post_pipeline(spark, d):
    path, schema = landed(spark, d, "conversations", 3, "conv_id")
    n = F.char_length("text")
    model = F.get(F.array(F.lit("prediction"), F.lit("analysis"), F.lit("after_action")), (F.col("turn") % 3).cast("int"))
    rows = feeds.read_feed(spark, path, schema).select("conv_id", "turn", model.alias("model"), (F.col("conv_id") % 5 == 0).alias("entered"), (n % 7 == 0).alias("pnl"), ((n % 11) / 10).alias("confidence"))
    kind = research.post_type(F.col("model"), F.col("entered"), F.col("pnl"))
    out = new_path(spark, "posts")
    feeds.run_to_end(rows.filter(research.to_alert(kind, F.col("entered"), F.col("confidence"))).select("conv_id", "turn", "confidence"), new_path(spark, "progress"), out=out)
    return spark.read.parquet(out)


@query(f"""with recursive {LINKS}, pg as (select page_id, {NORMAL} as u from pages), e as (select distinct pg.u as src, l2.u as dst from (select page_id, {NORMAL} as u from l) l2 join pg using (page_id)),
c(url, round) as (select u, 0 from pg where page_id % 10 = 0 union select dst, round + 1 from c join e on url = src where round < 6)
select url, min(round) as round from c group by url""")
def crawl_fixpoint(spark, d):
    pages = table(spark, d, "pages").select("page_id", links.normal_url(F.col("url")).alias("src"))
    edges = found(spark, d).select("page_id", links.normal_url(F.col("url")).alias("dst")).join(pages, "page_id").select("src", "dst").distinct()
    return crawl(pages.filter("page_id % 10 = 0").select(F.col("src").alias("url")), edges)


#: Days after which a post is too late, tries after the first, and hours between them.
LATE, TRIES, HOURS = 2, 2, 6


def failing_model(texts, tried):
    """Stands in for a model that can't be reached at times: it answers once it was asked as often as the post's value says."""
    out = []
    for text, n in zip(texts, tried, strict=True):
        post = json.loads(text)
        kind = {"purchase": "prediction", "signup": "prediction", "view": "analysis"}.get(post["kind"], "after_action")
        answer = {"kind": kind, "confidence": (post["value"] * 100 % 100) / 100, "symbol": f"brand#{post['k']}/usdt"}
        out.append(json.dumps(answer) if n >= int(post["value"]) % 4 else None)
    return out


def answered(rows):
    a = F.from_json("answer", "kind string, confidence double, symbol string").alias("a")
    return rows.select("author", "post_id", "ai_retry_count", a).select("author", "post_id", "ai_retry_count", "a.kind", F.round("a.confidence", 4).alias("confidence"), "a.symbol")


def posts_of(rows):
    fields = F.struct(F.col("event_type").alias("kind"), F.abs("value").alias("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.select(F.col("user_id").alias("author"), F.col("event_id").alias("post_id"), "ts", F.to_json(fields, {"ignoreNullFields": "false"}).alias("text"))


POSTS = f"""
b as (select p_brand as symbol, min(p_partkey) as asset_id from part group by 1),
x as (select *, floor(abs(value))::int % 4 as fails, json_extract_string(props, '$.k') as k, (select max(ts) from events) - interval {LATE} day as closed from events),
y as (select *, least(fails, {TRIES}) as n, fails > {TRIES} as failed from x),
z as (select user_id as author, event_id as post_id, n as ai_retry_count, failed, case event_type when 'purchase' then 'prediction' when 'signup' then 'prediction' when 'view' then 'analysis' else 'after_action' end as kind,
  round((abs(value) * 100 % 100) / 100, 4) as confidence, 'BRAND#' || k as symbol from y where ts + to_hours(n * {HOURS}) <= closed)"""


def landed_posts(spark, d):
    """The events as posts that land in three parts of time, each run from the checkpoint of the one before."""
    assets = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("symbol"))
    aliases = spark.createDataFrame([], "alias string, asset_id long")
    sink = streamed.Landed(spark, new_path(spark, "landed-posts"), answered, lambda rows: authors.named_assets(rows, assets, aliases), research.to_alert(F.col("kind"), F.lit(False), F.col("confidence")) & F.col("asset_id").isNotNull())
    with streamed.rocks_state(spark):
        in_time(spark, d, 3, None, lambda rows: streamed.classified(posts_of(rows), failing_model, f"{LATE} days", TRIES, HOURS * 3_600_000), sink)
    return sink


@query(f"with {POSTS} select author, post_id, failed as ai_failed, ai_retry_count from z")
def stream_posts(spark, d):
    """Every post whose tries are over, with how it ended."""
    return landed_posts(spark, d).archive().select("author", "post_id", "ai_failed", "ai_retry_count")


@query(f"with {POSTS} select author, post_id, kind, confidence, asset_id, kind = 'prediction' and confidence >= 0.8 and asset_id is not null as is_alerted from z left join b on upper(b.symbol) = z.symbol where not failed")
def stream_signals(spark, d):
    """The signals of the posts that were answered, with their assets, and which of them were alerted."""
    return landed_posts(spark, d).signals().select("author", "post_id", "kind", "confidence", "asset_id", "is_alerted")


@query("""with c as (select max(ts) - interval 2 day as closed from events), s as (select event_id as signal_id, user_id, ts from events, c where event_type = 'purchase' and ts <= closed),
f as (select event_id as fact_id, user_id, ts, event_type as fact, value from events where event_type in ('error', 'view'))
select signal_id, count(fact_id) as facts, round(sum(value) filter (fact = 'error'), 4) as moved, arg_max(value, (f.ts, fact_id)) filter (fact = 'view') as funding
from s left join f on s.user_id = f.user_id and f.ts between s.ts - interval 12 hour and s.ts group by 1""")
def stream_enrichment(spark, d):
    """Signals with the facts of the twelve hours before, joined as streams, of all intervals that are closed."""
    out, e = new_path(spark, "enriched"), table(spark, d, "events")

    def joined(rows):
        signals = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("signal_id"), "user_id", F.col("ts").alias("signal_ts"))
        facts = rows.filter("event_type in ('error', 'view')").select(F.col("event_id").alias("fact_id"), "user_id", F.col("ts").alias("fact_ts"), F.col("event_type").alias("fact"), "value")
        return feeds.interval_joined(signals, facts, "user_id", "signal_ts", "fact_ts", "12 hours", late="1 day")

    in_time(spark, d, 3, out, joined)
    rows = spark.read.schema("signal_id long, signal_ts timestamp, user_id long, fact_id long, fact_ts timestamp, fact string, value double").parquet(out)
    closed = F.lit(e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]) - F.expr("interval 2 days")
    g = rows.filter(F.col("signal_ts") <= closed).groupBy("signal_id")
    return g.agg(
        F.count("fact_id").alias("facts"), F.round(F.sum(F.when(F.col("fact") == "error", F.col("value"))), 4).alias("moved"),
        F.max_by(F.when(F.col("fact") == "view", F.col("value")), F.when(F.col("fact") == "view", F.struct("fact_ts", "fact_id"))).alias("funding"),
    )

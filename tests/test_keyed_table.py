"""Versions of a keyed table, and aggregates kept in one."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.operators import partials, recommend
from marlstone.sources.keyed_table import Conflict, KeyedTable
from marlstone.storage import new_path

SCHEMA = "k long, v string, n long"


@pytest.fixture
def table(spark):
    return KeyedTable(spark, new_path(spark, "keyed"), spark.createDataFrame([], SCHEMA).schema, ("k",), 8)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_versions_and_replays(spark, table):
    assert table.version() == 0 and of(table.read()) == []
    a = table.merge(rows(spark, *[(i, "a", 1) for i in range(100)]), "one", order=[F.col("n")])
    b = table.merge(rows(spark, (3, "b", 2), (4, "old", 0), (500, "new", 1), (None, "no key", 1)), "two", order=[F.col("n")])
    assert (a.version, b.version) == (1, 2) and a.buckets == 8 and 1 <= b.buckets <= 4
    want = [(i, "b" if i == 3 else "a", 2 if i == 3 else 1) for i in range(100)] + [(500, "new", 1), (None, "no key", 1)]
    assert of(table.read()) == sorted(want, key=str)
    assert of(table.read(1)) == sorted([(i, "a", 1) for i in range(100)], key=str)
    again = table.merge(rows(spark, (3, "b", 2), (4, "old", 0)), "two", order=[F.col("n")])
    assert again.replayed and again.version == 2 and again.bytes_written == 0 and table.version() == 2
    assert of(table.changes(1)) == sorted([(3, "b", 2), (500, "new", 1), (None, "no key", 1)], key=str)


def test_only_touched_buckets_are_written(spark, table):
    table.merge(rows(spark, *[(i, "x" * 50, 1) for i in range(5000)]), "all")
    before = table.manifest()["buckets"]
    done = table.merge(rows(spark, (7, "y", 2)), "one row")
    after = table.manifest()["buckets"]
    assert done.buckets == 1 and sum(before[b] != after[b] for b in before) == 1 and done.bytes_written < done.bytes_total / 4


def test_a_second_writer_fails(spark, table, monkeypatch):
    table.merge(rows(spark, (1, "a", 1)), "one")
    other = KeyedTable(spark, table.path, table.schema, ("k",), 8)
    real, calls = KeyedTable.version, []

    def late(self):  # sees the table as it was before the other's merge
        calls.append(1)
        return real(self) if len(calls) > 1 else 0

    monkeypatch.setattr(KeyedTable, "version", late)
    with pytest.raises(Conflict):
        other.merge(rows(spark, (2, "b", 1)), "two")
    monkeypatch.undo()
    assert of(table.read()) == [(1, "a", 1)]
    assert other.merge(rows(spark, (2, "b", 1)), "two").version == 2 and of(table.read()) == [(1, "a", 1), (2, "b", 1)]


def test_empty_merge(spark, table):
    assert table.merge(spark.createDataFrame([], SCHEMA), "none").version == 1 and of(table.read()) == []


def test_kept_states_equal_the_whole(spark):
    t0 = datetime.datetime(2024, 1, 1)
    quotes = [(i, i % 5, t0 + datetime.timedelta(hours=i * 7 % 200, minutes=i), float(i % 13)) for i in range(300)] + [(1000, None, t0, 1.0), (1001, 1, None, 1.0), (1002, 1, t0, None)]
    df = spark.createDataFrame(quotes, "quote_id long, asset_id long, ts timestamp, price double")
    kept = partials.Kept(partials.state_table(spark, new_path(spark, "states"), 4))
    for number, part in enumerate((df.filter("quote_id % 3 = 0"), df.filter("quote_id % 3 = 1"), df.filter("quote_id % 3 = 1"), df.filter("quote_id % 3 = 2"))):
        kept(part, min(number, 1) if number < 3 else 2)
    assert [d.replayed for d in kept.done] == [False, False, True, False]
    r = lambda df: sorted((x.asset_id, x[1], x.price, x.volume, round(x["mean"], 9), round(x.deviation, 7), x.low, x.high) for x in df.collect())
    whole = partials.daily_figures(partials.daily_state(df))
    assert r(partials.daily_figures(kept.table.read())) == r(whole)
    by_week = df.filter("asset_id is not null and ts is not null").groupBy("asset_id", F.date_trunc("week", "ts").cast("date").alias("w")).agg(F.count("*").alias("n"), F.max("price").alias("high"))
    assert sorted(map(tuple, by_week.collect())) == sorted((x.asset_id, x.week, x.volume, x.high) for x in partials.weekly_figures(kept.table.read()).collect())


def test_features_do_not_look_ahead(spark):
    day = datetime.date(2024, 1, 1)
    data = [(a, day + datetime.timedelta(days=t), float(1 + (a * 7 + t * 3) % 11), 1 + (a + t) % 4, (a + t) % 3, t % 2) for a in range(4) for t in range(20) if (a + t) % 5]
    df = spark.createDataFrame(data, "asset_id long, trade_date date, price double, volume long, buys long, sells long")
    cut = day + datetime.timedelta(days=11)
    whole = sorted(map(tuple, recommend.features(df).filter(F.col("trade_date") <= F.lit(cut)).collect()))
    known = sorted(map(tuple, recommend.features(df.filter(F.col("trade_date") <= F.lit(cut))).collect()))
    assert whole == known and all(0 <= x <= 100 for r in whole for x in r[3:])


def test_archive_keeps_the_first_run(spark):
    kept = recommend.archive_table(spark, new_path(spark, "archive"), 4)
    rec = lambda score, price: spark.createDataFrame([(datetime.date(2024, 1, 1), "S", "c", 1, "x", price, score, "1/3")], recommend.ARCHIVE)
    recommend.archive(kept, rec(80.0, 2.0), "monday")
    recommend.archive(kept, rec(10.0, 3.0), "tuesday")
    prices = spark.createDataFrame([(1, datetime.date(2024, 1, d), p) for d, p in ((1, 2.0), (2, 3.0), (8, 1.0))], "asset_id long, trade_date date, price double")
    r = recommend.outcomes(kept.read(), prices).first()
    assert (r.band, r.held, r.ret_1, r.ret_3, r.ret_7) == (">=70", -0.5, 0.5, None, -0.5)

"""Endpoints for any asset and any text."""

import duckdb

from marlstone.plans.api import ask
from marlstone.plans.catalogue import ORACLES

FOLDER = "/root/testdata/sf0.001"


def test_competitors_of_every_asset(spark):
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    every = c.sql(ORACLES["sector_competitors"].replace("where p_partkey <= 5", ""))
    own = ask(spark, FOLDER, "competitors")
    assert sorted(map(tuple, own.select(every.columns).collect())) == sorted(every.fetchall())
    assert 0 < ask(spark, FOLDER, "competitors", 6).count() <= 10


def test_search_takes_its_text(spark):
    rows = ask(spark, FOLDER, "search", text="Brand#13").collect()
    assert rows and all("Brand#13" in r.symbol for r in rows)


def test_search_by_index_and_tier(spark):
    from marlstone.operators import trigram
    from marlstone.plans.entity_queries import listed
    from marlstone.plans.selection_queries import in_tier

    index = trigram.build_index(listed(spark, FOLDER), 4)
    plain = ask(spark, FOLDER, "search", text="Brand#1").collect()
    assert ask(spark, FOLDER, "search", text="Brand#1", index=index).collect() == plain
    top = {r.asset_id for r in in_tier(listed(spark, FOLDER), spark, FOLDER, "top100").collect()}
    some = ask(spark, FOLDER, "search", text="Brand#1", tier="top100", index=index).collect()
    assert 0 < len(some) <= 50 and {r.asset_id for r in some} <= top
    contract = listed(spark, FOLDER).filter("contract is not null").first()
    assert [(r.asset_id, r["rank"]) for r in ask(spark, FOLDER, "search", text=contract.contract, index=index).collect()] == [(contract.asset_id, 0)]


def test_tier_of_matrix_and_coverage(spark):
    every, tier = ask(spark, FOLDER, "correlation-matrix").count(), ask(spark, FOLDER, "correlation-matrix", tier="top100").count()
    assert 0 < tier <= every and ask(spark, FOLDER, "correlation-matrix", tier="top1000").count() == 0
    assert {r.tier for r in ask(spark, FOLDER, "coverage-by-tier", tier="top100").collect()} == {"top100"}


def test_answers_and_thesis(spark):
    from marlstone.plans.api import answer, thesis, thesis_inputs

    q = spark.read.parquet(f"{FOLDER}/benchmark.parquet").selectExpr("item_id as question", "text").limit(3)
    assert all(r.citations and "[1]" in r.answer for r in answer(spark, FOLDER, q).collect())
    rows = thesis_inputs(spark, FOLDER, 1).collect()
    assert {r.part for r in rows} == {"valuation", "chips", "sentiment", "catalyst"} and len({(r.part, r.metric) for r in rows}) == len(rows) >= 14
    parts = {r.part: r for r in thesis(spark, FOLDER, 1).collect()}
    assert len(parts) == 4 and all(r.figures and r.text.startswith("Only from these") for r in parts.values())
    assert {r.text for r in thesis(spark, FOLDER, 10**9).collect()} == {"no figures"}

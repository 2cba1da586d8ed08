"""BM25 against a plain sum, nearest vectors, citations held to their sources, and trigram search against scans."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import entities, retrieval, trigram

DOCS = [(1, "The vault holds tokens. Tokens unlock in May."), (2, "May the vault hold! " * 90), (3, None), (4, " \n "), (5, "Ünlock the Vault, the vault"), (6, "nothing here"), (6, "nothing here")]


def plain_bm25(rows, question, k1=1.2, b=0.75):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    own = [(d, p, words(t)) for d, p, t in rows]
    mean = sum(len(w) for *_, w in own) / len(own)
    out = []
    for d, p, w in own:
        n, s = Counter(w), 0.0
        for t in set(words(question)):
            df = sum(t in x for *_, x in own)
            if n[t]:
                s += round(math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * n[t] * (k1 + 1) / (n[t] + k1 * (1 - b + b * len(w) / mean)), 8)
        if s:
            out.append((-round(s, 8), d, p))
    return sorted(out)


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([r for r in DOCS if r != DOCS[-1]], "doc_id long, text string")
    return retrieval.build_index(retrieval.passages(df, 50), 8)


def test_passages(spark):
    rows = retrieval.passages(spark.createDataFrame(DOCS, "doc_id long, text string"), 50).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 8, 5: 1, 6: 2}
    assert all(len(r.text.split()) <= 50 for r in rows) and " ".join(r.text for r in sorted(rows, key=lambda r: r.passage) if r.doc_id == 2).split() == DOCS[1][1].split()


def test_bm25(spark, index):
    rows = [(r.doc_id, r.passage, r.text) for r in index.read("passages").collect()]
    asked = {1: "When do tokens unlock from the vault?", 2: "vault vault VAULT", 3: "absent", 4: "", 5: "nothing"}
    found = retrieval.search(index, spark.createDataFrame(list(asked.items()), "question long, text string"), 3).collect()
    for q, text in asked.items():
        got = [(-round(r.score, 8), r.doc_id, r.passage) for r in sorted(found, key=lambda r: r.rank) if r.question == q]
        assert [(pytest.approx(s, abs=1e-6), d, p) for s, d, p in plain_bm25(rows, text)[:3]] == got


def test_index_reads_only_the_buckets_of_the_question(spark, index):
    q = spark.createDataFrame([(1, "tokens")], "question long, text string")
    plan = retrieval.search(index, q)._jdf.queryExecution().toString()
    read = re.findall(r"PartitionFilters: \[([^\]]*bucket[^\]]*)\]", plan)
    assert read and all("bucket" in x for x in read)
    again = retrieval.open_index(spark, index.path)
    assert retrieval.search(again, q).collect() == retrieval.search(index, q).collect()


def test_empty_index(spark):
    index = retrieval.build_index(retrieval.passages(spark.createDataFrame([], "doc_id long, text string")), 4)
    q = spark.createDataFrame([(1, "tokens")], "question long, text string")
    assert retrieval.search(index, q).count() == 0
    assert [(r.answer, r.citations) for r in retrieval.answers(index, q).collect()] == [(retrieval.NOTHING, [])]


def test_grounded(spark):
    sources = ["tokens unlock in may", "the vault holds gold"]
    cases = {
        "Tokens unlock in May [1]. The vault holds gold [2][9].": ("Tokens unlock in May [1] . The vault holds gold [2]", [1, 2]),
        "Tokens unlock in June of next year by vote [1]": (retrieval.NOTHING, []),
        "Gold is in the vault [1] [2]": ("Gold is in the vault [2]", [2]),
        "No marker at all": (retrieval.NOTHING, []),
        "[1][2]": (retrieval.NOTHING, []),
        None: (retrieval.NOTHING, []),
    }
    df = spark.createDataFrame([(a, sources) for a in cases], "a string, s array<string>")
    got = {r.a: (r.g.answer, r.g.citations) for r in df.select("a", retrieval.grounded(F.col("a"), F.col("s")).alias("g")).collect()}
    assert got == cases


def test_answers_cite_what_was_found(spark, index):
    q = spark.createDataFrame([(1, "When do tokens unlock?"), (2, "zzz")], "question long, text string")
    out = {r.question: r for r in retrieval.answers(index, q, 2).collect()}
    assert out[1].citations[0].doc_id == 1 and "[1]" in out[1].answer and "Nobody" not in out[1].answer
    assert out[2].answer == retrieval.NOTHING and not out[2].citations


@pytest.mark.parametrize("most", [1024, 2])
def test_nearest(spark, most):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9), i % 3 / 10]) for i in range(50)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0]), (64, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = df.filter("id in (0, 7, 8, 9, 60, 62, 63)").withColumnRenamed("id", "question")
    found = retrieval.nearest(df, asked, 4, most).collect()
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for q, v in rows:
        if q in (0, 7, 8, 9, 60, 62, 63):
            fit = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 8), i) for i, w in rows if v and w and len(v) == len(w) and norm(v) and norm(w))[:4]
            assert [(-r.score, r.id) for r in sorted(found, key=lambda r: r.rank) if r.question == q] == fit


ASSETS = [
    (1, "BTC", "Bitcoin", None), (2, "ETH", "Ether coin", "0xAbCdEf12"), (3, "WETH", "Wrapped ether", "0xabcdeF99"), (4, "bit", "Bit of b", "So1BitCoin"), (5, None, "Abc", "so1bitcoin"),
    (6, "A", None, "0xABCDEF12"), (7, "x", "bitbitbit", ""), (8, "Ünïcode", "日本語", None), (9, None, None, None), (10, "0xabc", "0x protocol", None),
]


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame(ASSETS, "asset_id long, symbol string, name string, contract string").repartition(3)


@pytest.fixture(scope="module")
def asset_index(assets):
    return trigram.build_index(assets, 8)


@pytest.mark.parametrize("q", ["bit", "BITCOIN", "ether", "ETH", "e", "", "0xABCDEF12", "0xabcd", "0xabcdef", "0xAb", "0x", "So1BitCoin", "so1bitcoin", "So1", "日本語", "ïco", "t of", "none such", "bitb"])
def test_search_equals_the_scan(assets, asset_index, q):
    want = sorted((r.asset_id, r["rank"]) for r in entities.search(assets, q).collect())
    assert sorted((r.asset_id, r["rank"]) for r in trigram.search(asset_index, q).collect()) == want


def test_search_ranks(asset_index):
    got = lambda q: {r.asset_id: r["rank"] for r in trigram.search(asset_index, q).collect()}
    assert got("0xABCDEF12") == {2: 0, 6: 0} and got("0xabcdef") == {2: 2, 3: 2, 6: 2}
    assert got("So1BitCoin") == {4: 0} and got("bit") == {1: 2, 4: 1, 7: 2}


def test_search_reads_only_its_buckets(asset_index):
    plan = asset_index.postings([(trigram.INSIDE, "bit")])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    files = asset_index.postings([(trigram.INSIDE, "bit")]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"bucket=(\d+)", r.f)[1] for r in files}) == 1


def test_similar_equals_the_scan(assets, asset_index):
    for q in ("bitcoin", "ethr", "wraped ether"):
        s = F.round(entities.trigram_similarity(F.col("t"), F.lit(q)), 8).alias("s")
        both = assets.selectExpr("asset_id", "stack(2, 'symbol', symbol, 'name', name) as (field, t)").filter("t is not null")
        want = sorted(map(tuple, both.select("asset_id", "field", s).filter("s >= 0.3").collect()))
        assert sorted((r.asset_id, r.field, round(r.similarity, 8)) for r in trigram.similar(asset_index, q).collect()) == want


def test_empty_asset_index(assets):
    index = trigram.build_index(assets.limit(0), 4)
    assert trigram.search(index, "bit").count() == trigram.search(index, "e").count() == trigram.similar(index, "bit").count() == 0

"""Operators on words and spans against brute force."""

import hashlib
import re

import numpy as np
import zlib
from collections import Counter

import duckdb
import pytest

from marlstone.llm import decontam, licenses, pii, quality, queries, sharding
from marlstone.llm.text import row_key

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, name):
    ours = queries.QUERIES[name](spark, FOLDER).toPandas()
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    theirs = c.sql(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    key = lambda df: sorted(map(str, df[columns].round(9).astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert columns == sorted(theirs.columns) and key(ours) == key(theirs)


def test_short_items_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x A b C y a b c"), (2, None), (3, "a b"), (4, " ".join(map(str, range(30))))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "A, b! C"), (3, " ".join(map(str, range(5, 17)))), (4, ""), (5, None), (6, "zz")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (8, 6, ["1", "2"]), 2: (0, 0, []), 3: (2, 0, []), 4: (30, 12, ["3"])}
    assert {r.doc_id for r in decontam.decontaminated(docs, items).collect()} == {2, 3}


def test_blocks_of_windows_agree(spark, docs, benchmark, monkeypatch):
    whole = sorted(map(str, decontam.contamination(docs, benchmark).drop("k").collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 300)
    assert sorted(map(str, decontam.contamination(docs, benchmark).drop("k").collect())) == whole


def plain_pii(t):
    out = []
    for rank, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark):
    texts = ["a@b.c+d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (234) 555-0100 +12 3", "é@ü x.y@z.w é 1.2.3.4", "\x01a@b.c\x01",
             "a..b@c.d..e 12345678901234567890123 +1111111111111111", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r.spans if s["base"]) for r in pii.spans_by_document(df, pii.personal_data(df)).collect()}
    assert got == {i: plain_pii(t or "") for i, t in enumerate(texts)}


def plain_before(text, start):
    """The last three words left of a place, of each its last 40 characters."""
    words = re.split(r"[ \t\n\x0b\f\r]+", text[:start])
    return [w[-40:] for w in words[-3:]]


def test_contexts_are_the_words_before_whatever_was_matched(spark, docs):
    rng = np.random.default_rng(5)
    parts = ["a@b.c", "key1=", " ", "\n\t ", "zz99-yyxx", "word", '"', "12.34.56.78", ":" * 50, "x" * 60, "secret2", " " * 90, "=", "+1 234 555 0100"]
    texts = ["".join(rng.choice(parts, 40)) for _ in range(150)] + [r.text for r in docs.select("text").collect()][:60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keys = {bytes(r.k): r.text for r in df.select(row_key().alias("k"), "text").collect()}
    rows = pii.matches(df).collect()
    assert len(rows) > 500
    for r in rows:
        text = keys[bytes(r.k)]
        assert text[r.start : r.end] == r.value and r.before == plain_before(text, r.start), (text, r)


def test_keys_with_digits_and_far_values(spark):
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(20)]
    rows = [(i, f'apikey_v2 = "{h}"') for i, h in enumerate(hexes)] + [(50, 'apikey_v2 = "zz99-yyxx"')]
    rows += [(100 + i, f"token: {h}") for i, h in enumerate(hexes)] + [(151, "token: zz98-yyxx"), (152, "token:" + " " * 90 + "zz97-yyxx"), (153, "\n\ntoken:\n zz96-yyxx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got[50] == 'apikey_v2 = "<secret>"' and got[3] == 'apikey_v2 = "<secret>"'
    assert [got[i].split()[-1] for i in (151, 152, 153)] == ["<secret>"] * 3


def test_contexts_teach_new_identifiers(spark):
    seeds = [(i, f'some words token = "{hashlib.md5(str(i).encode()).hexdigest()}" end') for i in range(30)]
    df = spark.createDataFrame([*seeds, (100, 'other words token = "hunter2hunter" end'), (101, "in 2024-01-05 it was room101x")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got[100] == 'other words token = "<secret>" end' and got[101] == "in 2024-01-05 it was room101x" and got[3] == 'some words token = "<secret>" end'


def repeats(w, n=5):
    count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({i + j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(n)})


def test_quality_features(spark, docs, odd):
    for df in (docs.select("doc_id", "text", "source"), odd.select("doc_id", "text", "source").filter("doc_id < 100")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for r in quality.features(df).collect():
            t = texts[r.doc_id]
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w)), r.doc_id


def test_hosts_shrink_and_fall(spark):
    rows = [(i, "x " * 3 if h == "bad" else " ".join(f"w{i}word{j}" for j in range(40)), h) for i, h in enumerate(["bad"] * 50 + ["good"] * 50 + ["fair"] * 50 + [None] * 3)]
    rows += [(900, " ".join(f"fine{j}" for j in range(40)), "bad"), (901, "x x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {(r.host, r.rule): r for r in quality.host_rates(quality.features(df)).collect()}
    assert rates["bad", "few_words"].shrunk > 0.8 and rates["tiny", "few_words"].shrunk < rates["tiny", "few_words"].rate
    rows = quality.host_quality(df).collect()
    kept = {r.doc_id: r.kept for r in rows}
    fallen = {r.host for r in quality.host_verdicts(quality.host_rates(quality.features(df))).filter("host_failed").collect()}
    assert all(r.kept == (not r.base_failed and r.host not in fallen) for r in rows) and "bad" in fallen and len(rows) == df.count()
    assert not kept[900] and kept[60] and kept[120] and kept[151] and not kept[901]


def test_a_worse_host_falls(spark):
    """Two fifths of one host's documents fail, a fiftieth of the others'."""
    ok = " ".join(f"w{j}" for j in range(40))
    rows = [(i, "x x x" if i % 50 in (3, 13) or i % 500 < 10 and i % 10 != 3 else ok, "WWW.Host3" if i % 20 == 3 else f"host{i % 10}") for i in range(5000)]
    got = quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.host for r in got if not r.base_failed and not r.kept} == {"host3"} and all(not r.kept for r in got if r.host == "host3")


@pytest.mark.parametrize("name", ["op3", "op5", "op6", "op8", "op10"])
def test_empty_and_odd_tables(spark, odd, empty, benchmark, name):
    run = {
        "op3": lambda d: decontam.contamination(d, benchmark), "op5": lambda d: pii.redacted(d), "op6": quality.host_quality,
        "op8": sharding.bounded_ring_shards, "op10": licenses.license_scan,
    }[name]
    assert run(empty).count() == 0 and run(odd).count() == odd.count()


def test_shards_are_even_and_few_move(spark, docs, odd):
    for df, n in ((docs, 24), (odd, 5)):
        rows = sharding.bounded_ring_shards(df, n).collect()
        assert len(rows) == df.count()
        by = Counter(r.shard for r in rows)
        counts = [by[s] for s in range(n)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(by[s])) for s in by)
    one, two = ({r.doc_id: r.shard for r in sharding.bounded_ring_shards(docs, n).collect()} for n in (8, 9))
    assert sum(one[k] != two[k] for k in one) < 0.2 * len(one)  # a ninth of all must move
    one, two = ({r.doc_id: r.shard for r in sharding.bounded_ring_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), n).collect()} for n in (24, 25))
    assert sum(one[k] != two[k] for k in one) < 0.1 * len(one)


def test_sizes_and_checksums_of_shards(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_ring_shards"](spark, FOLDER).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_license_bounds(spark):
    rows = [(1, "Text. Licensed under the Apache License, Version 2.0. More text."), (2, "licensed under THE apache license version 2.0\nRELEASED under the MIT license"), (3, "the license of a thing"), (4, None), (5, "word " * 5000)]
    got = {r.doc_id: (r.n_notices, r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "apache-2.0"), 2: (2, "apache-2.0,mit"), 3: (0, ""), 4: (0, ""), 5: (0, "")}

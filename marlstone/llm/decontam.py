"""Benchmark passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import NOT_ALNUM, ascii_lower, covered, fresh, hashes, row_key, window_hash, window_hashes, words
from marlstone.storage import stored

#: Words of a window, and the most windows that one broadcast holds (about 300 bytes each).
WINDOW, BROADCAST_WINDOWS = 10, 100_000


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """len, h, passage and items (sorted ids as strings) of every distinct window of the benchmark.

    A window is n consecutive words; an item of fewer words, but not none, is one window.
    """
    df = benchmark.select("item_id", words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w")).filter(F.size("w") > 0)
    df = df.withColumn("h", hashes(F.col("w"))).withColumn("len", F.least(F.size("w"), F.lit(n)))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    h = F.col("h")
    hashed = F.coalesce(*[F.when(F.col("len") == k, window_hash(h, F.col("i"), k)) for k in range(n, 0, -1)])
    df = df.select("item_id", "len", hashed.alias("h"), F.array_join(F.slice("w", F.col("i") + 1, F.col("len")), " ").alias("passage"))
    return df.groupBy("len", "h", "passage").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def benchmark_hits(docs: DataFrame, windows: DataFrame, n_windows: int, lengths: list[int]) -> DataFrame:
    """k, pos, len and items_class of every place where a window of the benchmark occurs in a document.

    The hash set is broadcast in blocks of BROADCAST_WINDOWS at most, one scan of the documents for each.
    Every hit is verified by its words.
    """
    lengths = sorted(lengths, reverse=True)
    df = docs.select(row_key().alias("k"), words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    df = df.withColumn("h", hashes(F.col("w")))
    scans = [window_hashes(F.col("h"), k) for k in lengths]
    df = df.select("k", "w", F.concat(*scans).alias("scan"))
    # The outer form: the plain one infers a filter that would hash every window once more below.
    df = df.select("k", "w", F.posexplode_outer("scan").alias("at", "h"))
    # The scans of the lengths follow each other: the place tells the length.
    size, before = F.size("w"), F.lit(0)
    length, pos = F.lit(None).cast("int"), F.lit(None).cast("int")
    cases = []
    for k in lengths:
        count = F.greatest(size - (k - 1), F.lit(0))
        cases.append((F.col("at") < before + count, k, F.col("at") - before))
        before = before + count
    for hit, k, p in reversed(cases):
        length, pos = F.when(hit, F.lit(k)).otherwise(length), F.when(hit, p).otherwise(pos)
    found = []
    blocks = -(-n_windows // BROADCAST_WINDOWS)
    for b in range(blocks):
        part = windows.filter(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else windows
        part = part.select("h", "passage", F.xxhash64("items").alias("items_class"))
        hit = df.join(F.broadcast(part), "h").withColumn("len", length).withColumn("pos", pos)
        # Two prefix tests, as an equality would become a join key, built for every window.
        run = F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ")
        hit = hit.filter(F.startswith(F.col("passage"), run) & F.startswith(run, F.col("passage")))
        found.append(hit.select("k", "pos", "len", "items_class"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """k, doc_id, n_words, n_hit, items and hits (pos, len) of every document.

    Null text has no words. Equal rows get equal results; null ids are ids. An empty benchmark hits nothing; an empty
    table gives no rows. Texts are scanned whole, however long; other columns, whatever their names, play no part.
    """
    windows = stored(item_windows(benchmark, n), "benchmark-windows")
    stats = windows.groupBy("len").count().collect()  # n rows at most
    base = docs.select("doc_id", row_key().alias("k"), F.size(words(ascii_lower(F.col("text")), NOT_ALNUM)).cast("long").alias("n_words"))
    nothing = (F.array().cast("array<struct<pos:int,len:int>>"), F.array().cast("array<string>"))
    if not stats:
        return base.select("k", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), nothing[1].alias("items"), nothing[0].alias("hits"))
    found = stored(
        benchmark_hits(docs, windows, sum(r["count"] for r in stats), [r["len"] for r in stats]), "benchmark-hits"
    )
    spans = found.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("hits"))
    classes = windows.select(F.xxhash64("items").alias("items_class"), "items").dropDuplicates(["items_class"])
    items = (
        found.select("k", "items_class").distinct().join(classes, "items_class")
        .groupBy("k").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    out = base.join(spans, "k", "left").join(items, "k", "left")
    return out.select(
        "k",
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("hits")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", nothing[1]).alias("items"),
        F.coalesce("hits", nothing[0]).alias("hits"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns as they are, whatever their names."""
    key, = fresh(docs, "k")
    hit = contamination(docs, benchmark, n).filter("n_hit > 0").select(F.col("k").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(hit, key, "left_anti").select(docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bi as (select item_id, w, least(len(w), 10) as n, unnest(range(0, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') as passage from bi),
lens as (select distinct n from bw),
di as (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, lens where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as passage from di),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.passage = bw.passage),
pos as (select distinct doc_id, unnest(range(i, i + n)) as p from hit),
nh as (select doc_id, count(*) as n_hit from pos group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
       from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join nh using (doc_id) left join it using (doc_id)
"""

"""Merkle manifest of a table: nodes labelled by the leaf ranks that they cover, proofs from the labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.storage import stored

#: Levels of the tree in a bucket: a bucket's interval covers 2**BAND nodes of its lowest level.
BAND = 8

PATH = "array<struct<left:boolean,digest:string>>"


def field(value: Column) -> Column:
    """A value as bytes, a colon and the value; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def ranked(leaves: DataFrame) -> DataFrame:
    """Adds rank, from 0 within each tree by doc_id (null first), then digest.

    Leaves are written in range partitions; a rank is the number of the tree's leaves in earlier partitions and the
    place in the own one, so no task sees more than a partition, however large a tree is.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The digest is part of the range, so that a doc_id of many rows is cut too.
    order = [F.asc_nulls_first("tree"), F.asc_nulls_first("doc_id"), F.col("digest")]
    rows = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "merkle-ranks")
    sizes = rows.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").withColumnsRenamed({"tree": "_tree", "_part": "_p"})
    # A row for each partition and tree: Spark broadcasts it where its size allows, else a hot pair is split.
    out = rows.join(sizes, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return out.withColumn("rank", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_p", "_tree", "_first", "_before")


def _parents(nodes: Column) -> Column:
    """The digests of the parents of sorted nodes (lo, hi, digest): each covers two, the last one or two."""
    n = F.size(nodes)

    def parent(i: Column) -> Column:
        a, b = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), F.sha2(F.concat(a["digest"], F.coalesce(b["digest"], F.lit(""))), 256).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), parent)


@dataclass
class Bucket:
    """Buckets of one band of levels: tree, lo, hi, items and levels; lowest is the band's first level."""

    rows: DataFrame
    lowest: int


def buckets(items: DataFrame, lowest: int) -> Bucket:
    """The nodes of one level (tree, lo, hi, digest and payload) in buckets of aligned intervals, with the levels above.

    A bucket holds the sorted items that its interval covers, 2**BAND at most, and levels: for each level of the band,
    its nodes with the intervals they cover. A tree whose items are one node has no level above.
    """
    size = items.groupBy("tree").agg(F.count("*").alias("m")).withColumnRenamed("tree", "_tree")
    rows = items.groupBy("tree", F.shiftright("lo", lowest + BAND).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "payload"))).alias("items"))
    rows = rows.join(size, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    # As many levels as m - 1 has binary digits, m nodes need above them.
    height = F.when(F.col("m") == 1, 0).otherwise(F.least(F.lit(BAND), F.char_length(F.bin(F.col("m") - 1))))
    rows = rows.withColumns({"height": height, "level0": F.transform("items", lambda x: F.struct(x["lo"], x["hi"], x["digest"]))})
    for k in range(1, BAND + 1):  # columns, one on the other: an expression in itself would double each time
        rows = rows.withColumn(f"level{k}", F.when(F.col("height") >= k, _parents(F.col(f"level{k - 1}"))))
    levels = F.filter(F.array(*[f"level{k}" for k in range(BAND + 1)]), lambda x: x.isNotNull())
    rows = rows.select("tree", "bucket", "items", levels.alias("levels"))
    return Bucket(stored(rows, "merkle-buckets"), lowest)


def roots(b: Bucket) -> DataFrame:
    """The buckets' own nodes, items of the band above."""
    top = F.get(F.element_at("levels", -1), F.lit(0))
    return b.rows.select("tree", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"), F.col("bucket").alias("payload"))


def siblings(x: Column, levels: Column, lowest: int) -> Column:
    """The path of an item in its bucket: at each level the sibling of the ancestor whose interval contains the item's.

    The sibling's interval is what the parent's has besides the ancestor's own, left or right of it; where nothing is
    left, the digest is null. Nodes of a level stand in order of their intervals, so an interval names its place.
    """
    first = F.get(F.get(levels, F.lit(0)), F.lit(0))["lo"]

    def at(level: Column, lo: Column) -> Column:
        return F.get(F.get(levels, level), F.call_function("shiftright", lo - first, level + lowest).cast("int"))

    def step(level: Column) -> Column:
        own, parent = at(level, x["lo"]), at(level + 1, x["lo"])
        left = parent["lo"] < own["lo"]
        there = left | (own["hi"] < parent["hi"])
        digest = F.when(there, at(level, F.when(left, parent["lo"]).otherwise(own["hi"]))["digest"])
        return F.struct(left.alias("left"), digest.alias("digest"))

    return F.when(F.size(levels) < 2, F.array().cast(PATH)).otherwise(F.transform(F.sequence(F.lit(0), F.size(levels) - 2), step))


def paths(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops): every item (tree, rank, digest, payload) with its path to its tree's top, and the top of each tree.

    Buckets are built from the leaves up, BAND levels each. Ancestors are attached from the top down: a bucket takes the
    path of its own node from the bucket above whose interval contains it, an equi-join on the bucket's number. So each
    leaf is shuffled once, in groups of 2**BAND at most.
    """
    now, built, lowest = items.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "payload"), [], 0
    while True:
        built.append(buckets(now, lowest))
        now, lowest = roots(built[-1]), lowest + BAND
        if not built[-1].rows.filter("bucket > 0").head(1):
            break
    tops = now.select("tree", "digest")
    above = None
    for b in reversed(built):
        rows = b.rows.withColumn("above", F.array().cast(PATH))
        if above is not None:
            up = above.select(F.col("tree").alias("_tree"), F.col("payload").alias("_bucket"), F.col("path").alias("_path"))
            rows = b.rows.join(up, (F.col("bucket") == F.col("_bucket")) & F.col("tree").eqNullSafe(F.col("_tree"))).withColumnRenamed("_path", "above")
        x = F.explode("items")
        rows = rows.select("tree", "levels", "above", x.alias("x"))
        above = rows.select("tree", F.col("x.payload").alias("payload"), F.col("x.digest").alias("digest"), F.concat(siblings(F.col("x"), F.col("levels"), b.lowest), "above").alias("path"))
    return above, tops


def folded(start: Column, path: Column) -> Column:
    """The top that a leaf gives with the siblings of its path."""

    def step(a: Column, s: Column) -> Column:
        d = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(d, a)).otherwise(F.concat(a, d)), 256)

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    docs: doc_id, source, lang, n_chars, text. Each language is a tree whose leaves ascend by doc_id; its top is
    subroot, and the tops, by language, are the leaves of root's tree. proof_sha256 is over the siblings from the leaf
    to root. tampered: n_chars as it is found later; folded_root is recomputed from it.

    Nulls are dashes in the leaf; null doc_id and null lang come first; equal doc_ids run by leaf; repeated rows are
    leaves of their own with equal digests; text of any length is hashed whole; a table of one row is its own leaf,
    subroot and root, with an empty proof; other columns play no part; an empty table gives no rows.
    """
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    found = leaf(**c | {"n_chars": tampered}) if tampered is not None else F.lit(None).cast("string")
    differs = F.lit(False) if tampered is None else ~tampered.eqNullSafe(F.col("n_chars"))
    leaves = docs.select("doc_id", F.col("lang").alias("tree"), leaf(**c).alias("digest"), F.when(differs, found).alias("found"))
    leaves = ranked(stored(leaves, "merkle-leaves"))
    nodes, tops = paths(leaves.withColumn("payload", F.struct("doc_id", "found")))
    tops = stored(tops, "merkle-subroots")
    # Languages are the leaves of one more tree.
    upper = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").cast("binary").alias("doc_id"), "digest", F.col("tree").alias("lang")))
    upper, top = paths(upper.withColumn("payload", F.struct("lang")))
    root = top.select("digest").first()  # one digest, or none of an empty table
    upper = upper.select(F.col("payload.lang").alias("_lang"), F.col("digest").alias("subroot"), F.col("path").alias("_above"), F.lit(root.digest if root else None).cast("string").alias("root"))
    out = nodes.join(upper, F.col("tree").eqNullSafe(F.col("_lang")))
    path = F.concat("path", "_above")
    proof = F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)
    out = out.select("payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("payload.found", "digest"), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13_SQL = f"""
with recursive bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
d as (select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(doc_id, 0)::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]))) as crc from documents, bits),
l as (select doc_id, lang, {_leaf_sql("n_chars")} as leaf, {_leaf_sql("(case when doc_id is not null and crc % 7 = 0 then n_chars + 1 else n_chars end)")} as found from d),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank from l),
n(lang, level, i, digest, m) as (select lang, 0, rank, leaf, count(*) over (partition by lang) from r
  union all select lang, level + 1, i // 2, sha256(string_agg(digest, '' order by i)), any_value((m + 1) // 2) from n where m > 1 group by lang, level, i // 2),
s as (select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as rank from n where m = 1),
u(level, i, digest, m) as (select 0, rank, subroot, count(*) over () from s union all select level + 1, i // 2, sha256(string_agg(digest, '' order by i)), any_value((m + 1) // 2) from u where m > 1 group by level, i // 2),
su as (select s.rank, k.level, x.digest, (s.rank // (2 ** k.level)::bigint) % 2 as odd from s, (select distinct level from u where m > 1) k left join u x on x.level = k.level and x.i = xor(s.rank // (2 ** k.level)::bigint, 1)),
sp as (select rank, list((case when odd = 1 then 'L' else 'R' end) || coalesce(digest, '') order by level) as path from su group by rank),
lu as (select r.lang, r.rank, k.level, x.digest, (r.rank // (2 ** k.level)::bigint) % 2 as odd
  from r join (select distinct lang, level from n where m > 1) k on r.lang is not distinct from k.lang left join n x on x.lang is not distinct from r.lang and x.level = k.level and x.i = xor(r.rank // (2 ** k.level)::bigint, 1)),
lp as (select lang, rank, list((case when odd = 1 then 'L' else 'R' end) || coalesce(digest, '') order by level) as path from lu group by lang, rank),
p as (select r.*, s.subroot, (select digest from u where m = 1) as root, list_concat(coalesce(lp.path, []), coalesce(sp.path, [])) as path
  from r join s on s.lang is not distinct from r.lang left join lp on lp.lang is not distinct from r.lang and lp.rank = r.rank left join sp on sp.rank = s.rank),
f as (select *, list_reduce(list_prepend(found, path), lambda a, x: case when x[1] = 'L' then sha256(x[2:] || a) else sha256(a || x[2:]) end) as folded_root from p)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""

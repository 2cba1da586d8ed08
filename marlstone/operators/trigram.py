"""Fuzzy search of assets by a stored table of trigram postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marlstone.operators import entities
from marlstone.storage import new_path

#: Kinds of postings: trigrams inside symbol and name, trigrams of a padded symbol or name, whole contracts, starts of 0x contracts.
INSIDE, PADDED, CONTRACT, START = "i", "p", "c", "s"
#: Characters of the shortest start of a 0x contract that is searched for by the index.
START_CHARS = 6


def inner(s: Column) -> Column:
    """Distinct trigrams of a text as it is; fewer than three characters have none."""
    n = F.char_length(s) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class AssetIndex:
    """postings (bucket, kind, gram, field, size, asset_id) in partitions by bucket, rows (part, ...) in partitions by asset_id."""

    spark: SparkSession
    path: str
    buckets: int
    schema: StructType

    def postings(self, keys: list[tuple[str, str]]) -> DataFrame:
        """The postings of the keys (kind, gram): reads their buckets only."""
        asked = self.spark.createDataFrame(keys, "kind string, gram string").withColumn("bucket", bucket(self.buckets))
        wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]
        grams = [g for _, g in keys]
        kind = self.schema["asset_id"].dataType.simpleString()
        stored = self.spark.read.schema(f"kind string, gram string, field string, size int, asset_id {kind}, bucket int").parquet(f"{self.path}/postings").filter(F.col("bucket").isin(wanted) & F.col("gram").isin(grams))
        return stored.join(F.broadcast(asked), ["bucket", "kind", "gram"], "left_semi")  # as many as a query's trigrams

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("part", IntegerType())])).parquet(f"{self.path}/rows")

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The assets of the ids, from the partitions that hold them; the numbers of those are bounded by the buckets."""
        ids = ids.select("asset_id").distinct().withColumn("part", part(self.buckets))
        wanted = [r.part for r in ids.select("part").distinct().collect()]
        return self.rows().filter(F.col("part").isin(wanted)).join(ids, ["part", "asset_id"], "left_semi").drop("part")


def bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("kind", "gram"), F.lit(n)).cast("int")


def part(n: int) -> Column:
    return F.pmod(F.xxhash64("asset_id"), F.lit(n)).cast("int")


def build_index(assets: DataFrame, buckets: int = 64, path: str | None = None) -> AssetIndex:
    """Writes the postings of assets (asset_id, symbol, name, contract; other columns are kept with the rows)."""
    spark = assets.sparkSession
    path = path or new_path(spark, "asset-index")
    assets.withColumn("part", part(buckets)).repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
    index = AssetIndex(spark, path, buckets, assets.schema)
    rows = index.rows()
    gram = lambda kind, field, grams: F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram"), F.lit(field).alias("field"), F.size(grams).alias("size")))
    none = F.array().cast("array<struct<kind:string,gram:string,field:string,size:int>>")
    found = []
    for field in ("symbol", "name"):
        s = F.lower(F.col(field))
        found += [F.when(s.isNotNull(), F.concat(gram(INSIDE, field, inner(s)), gram(PADDED, field, entities.trigrams(s)))).otherwise(none)]
    c = entities.normal_address(F.col("contract"))
    starts = F.when(c.startswith("0x") & (F.char_length(c) >= START_CHARS), F.array(F.substring(c, 1, START_CHARS))).otherwise(F.array().cast("array<string>"))
    found += [F.when(c.isNotNull(), F.concat(gram(CONTRACT, "contract", F.array(c)), gram(START, "contract", starts))).otherwise(none)]
    each = rows.select("asset_id", F.explode(F.concat(*found)).alias("g")).select("g.*", "asset_id").withColumn("bucket", bucket(buckets))
    # A frequent trigram's bucket is dealt over several files.
    each = each.withColumn("_deal", F.pmod(F.xxhash64("asset_id"), F.lit(8))).repartition("bucket", "_deal").drop("_deal")
    each.sortWithinPartitions("bucket", "kind", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    return index


def grams_of(q: str) -> list[str]:
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def candidates(index: AssetIndex, q: str) -> DataFrame | None:
    """asset_id of all assets that a search for q can find: its postings intersected; None where q is too short to have any."""
    low = q.lower()
    grams = grams_of(low)
    if not grams:
        return None
    keys = [(INSIDE, g) for g in grams]
    address = low if low.startswith("0x") else q
    keys.append((CONTRACT, address))
    if low.startswith("0x") and len(low) < START_CHARS:
        return None
    if low.startswith("0x"):
        keys.append((START, low[:START_CHARS]))
    found = index.postings(keys).groupBy("asset_id", "kind", "field").agg(F.count_distinct("gram").alias("n"))
    return found.filter((F.col("kind") != INSIDE) | (F.col("n") == len(grams))).select("asset_id").distinct()


def search(index: AssetIndex, q: str) -> DataFrame:
    """The rows of entities.search over all assets, from the postings of q's trigrams; each candidate is verified.

    A text of fewer than three characters, or a start of an address that is too short, has no postings: all rows are scanned.
    """
    ids = candidates(index, q)
    return entities.search(index.rows().drop("part") if ids is None else index.rows_of(ids), q)


def similar(index: AssetIndex, q: str, least: float = 0.3) -> DataFrame:
    """asset_id, field and similarity of symbols and names that share at least that share of trigrams with q, from the postings alone."""
    low = f"  {q.lower()} "
    grams = grams_of(low)
    found = index.postings([(PADDED, g) for g in grams]).groupBy("asset_id", "field", "size").agg(F.count_distinct("gram").alias("n"))
    share = F.col("n") / (F.col("size") + len(grams) - F.col("n"))
    return found.select("asset_id", "field", share.alias("similarity")).filter(F.col("similarity") >= least)

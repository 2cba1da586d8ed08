"""Assets from several sources: matching, search, sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag -> (sector, confidence); sector -> collection priority; lead days of unlock alerts.
TAG_SECTORS = {"layer-1": ("l1", 0.9), "layer-2": ("l2", 0.9), "defi": ("defi", 0.8), "memes": ("meme", 0.9), "gaming": ("gamefi", 0.8), "ai": ("ai", 0.7), "rwa": ("rwa", 0.8)}
SECTOR_PRIORITY = {"l2": 95, "ai": 90, "meme": 45}
UNLOCK_LEAD_DAYS = {"l2": 21, "ai": 21, "meme": None}


def normal_address(address: Column) -> Column:
    """Lower case for 0x addresses; others, which are case-sensitive, as they are."""
    return F.when(address.rlike("^0[xX]"), F.lower(address)).otherwise(address)


def base_symbol(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), "[-_/]?(USDT|USDC|BUSD|USD)$", "")


def cross_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id and matched_by: by contract address, and by symbol where a side has none.

    Both: id, symbol, contract. A row that matched by contract isn't tried by symbol.
    """
    l = left.select(F.col("id").alias("left_id"), F.upper("symbol").alias("s"), normal_address(F.col("contract")).alias("c"))
    r = right.select(F.col("id").alias("right_id"), F.upper("symbol").alias("s"), normal_address(F.col("contract")).alias("rc"))
    by_contract = l.filter("c is not null").join(r.filter("rc is not null"), F.col("c") == F.col("rc")).select("left_id", "right_id", F.lit("contract").alias("matched_by"))
    rest = l.join(by_contract.select("left_id").distinct(), "left_id", "left_anti").join(r, "s").filter("c is null or rc is null")
    rest = rest.join(by_contract.select("right_id").distinct(), "right_id", "left_anti")
    return by_contract.unionByName(rest.select("left_id", "right_id", F.lit("symbol").alias("matched_by")))


def search(assets: DataFrame, q: str) -> DataFrame:
    """Assets that match q, with rank: 0 contract, 1 symbol, 2 start of symbol, name or 0x contract, 3 inside. assets: asset_id, symbol, name, contract."""
    x = F.lit(q.lower())
    symbol, name, contract = F.lower("symbol"), F.lower("name"), normal_address(F.col("contract"))
    starts = symbol.startswith(x) | name.startswith(x)
    if q.lower().startswith("0x") and len(q) > 2:
        starts = F.coalesce(starts, F.lit(False)) | contract.startswith(x)
    rank = F.when(contract == normal_address(F.lit(q)), 0).when(symbol == x, 1).when(starts, 2).when(F.contains(symbol, x) | F.contains(name, x), 3)
    return assets.withColumn("rank", rank).filter("rank is not null")


def trigrams(s: Column) -> Column:
    """Distinct trigrams of a padded lower-case word."""
    p = F.concat(F.lit("  "), F.lower(s), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def sector_of(tags: Column) -> Column:
    """Sector of the most confident tag; other without a known one. Ties go to the greater name."""
    known = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"), F.lit(t).alias("t")) for t, (s, c) in TAG_SECTORS.items()])
    return F.coalesce(F.array_max(F.filter(known, lambda x: F.array_contains(tags, x["t"])))["s"], F.lit("other"))


def lead_days(sector: Column, default: int = 14) -> Column:
    """Days before an unlock at which an alert is due; null: none."""
    out = F.when(sector.isNull(), F.lit(default))
    for s, d in UNLOCK_LEAD_DAYS.items():
        out = out.when(sector == s, F.lit(d).cast("int"))
    return out.otherwise(default)

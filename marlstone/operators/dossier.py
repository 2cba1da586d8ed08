"""What is known of an asset and what is missing: materials, their visibility by sector, snapshots of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Materials judged by their own tables, materials judged by topics of links and topic of each.
STRUCTURED = ["official_website", "whitepaper", "github", "audit", "tokenomics", "holders", "social_heat", "unlocks", "contract"]
TOPIC_MATERIALS = {
    "tge": "tge_ido", "liquidity": "lp_liquidity", "treasury": "treasury_multisig", "team_vc": "team_vc", "roadmap": "roadmap",
    "dao_governance": "dao_governance", "bug_bounty": "bug_bounty", "listing": "exchange_listing", "research": "competitors",
    "announcement": "announcement", "third_party_rating": "third_party_rating", "incident": "onchain_incident",
}
MATERIALS = [*STRUCTURED, *TOPIC_MATERIALS.values()]
# Materials that every sector shows, and the sector without unlocks.
BASIC = ["official_website", "whitepaper", "github", "contract", "holders", "social_heat"]
NO_UNLOCKS = "meme"


def materials_of_topics(links: DataFrame, topics: str = "topics") -> DataFrame:
    """Distinct asset_id and material of links, by their array of topics; topics of no material and null arrays give none."""
    rows = links.select("asset_id", F.explode(topics).alias("topic")).distinct()
    table = F.create_map(*[F.lit(x) for pair in TOPIC_MATERIALS.items() for x in pair])
    return rows.select("asset_id", F.element_at(table, F.col("topic")).alias("material")).filter("material is not null").distinct()


def has_any(topics: Column, wanted: list[str]) -> Column:
    """Whether an array of topics has one of those wanted; false for null."""
    return F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, wanted))), F.lit(False))


def visible(material: Column, sector: Column, topics: dict[str, list[str]]) -> Column:
    """Whether a sector shows a material: basic ones always, unlocks unless it has none, others if it lists them."""
    listed = F.lit(False)
    for s, names in topics.items():
        listed = F.when(sector == s, material.isin(*names)).otherwise(listed)
    return material.isin(*BASIC) | F.when(material == "unlocks", F.coalesce(sector != NO_UNLOCKS, F.lit(True))).otherwise(listed)


def snapshot(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """source, asset_id, n and latest of every source: how many rows an asset has there and the time of its last one.

    parts: source -> (rows with asset_id, name of their time column). Each source combines before its shuffle.
    """
    out = None
    for source, (rows, time) in parts.items():
        g = rows.groupBy("asset_id").agg(F.count("*").alias("n"), F.max(F.col(time).cast("timestamp_ntz")).alias("latest"))
        g = g.select(F.lit(source).alias("source"), "asset_id", "n", "latest")
        out = g if out is None else out.unionByName(g)
    return out


def coverage(assets: DataFrame, parts: dict[str, DataFrame], tier: str = "tier") -> DataFrame:
    """Assets and the share of them with rows in each part, by tier and for all."""
    for name, rows in parts.items():
        assets = assets.join(rows.select("asset_id", F.lit(1).alias(name)).distinct(), "asset_id", "left")
    shares = [F.round(F.avg(F.coalesce(name, F.lit(0))), 6).alias(name) for name in parts]
    rows = assets.groupingSets([[F.col(tier)], []], F.col(tier)).agg(F.grouping(tier).alias("every"), F.count("*").alias("assets"), *shares)
    return rows.withColumn(tier, F.when(F.col("every") == 1, "all").otherwise(F.col(tier))).drop("every")


#: Types of evidence that come first, in their order.
EVIDENCE_FIRST = ["whitepaper", "tokenomics", "audit"]


def evidence(rows: DataFrame, most: int = 20) -> DataFrame:
    """The most pieces of evidence of each asset with place: by type, then the newest, then doc_id; without a date last.

    rows: asset_id, doc_id, kind, published_at. Each task keeps its own best before the shuffle.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EVIDENCE_FIRST)), F.col("kind")), F.lit(0))
    order = Window.partitionBy("asset_id").orderBy(F.when(rank > 0, rank).otherwise(len(EVIDENCE_FIRST) + 1), F.desc_nulls_last("published_at"), "doc_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)

"""Materials, watch lists, social heat and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Places of each type in a curated list, weights of social dimensions, material -> action in order.
QUOTAS = {"whitepaper": 3, "docs": 5, "site": 3, "github": 5, "blog": 5, "audit": 3, "other": 3}
SOCIAL_WEIGHTS = {"community": 0.25, "sentiment": 0.30, "trend": 0.25, "market": 0.20}
FILL_ACTIONS = {"official_website": "discover", "docs": "deep_crawl", "whitepaper": "deep_crawl", "audit": "third_party", "tokenomics": "extract", "unlocks": "extract"}
ACTION_ORDER = ["discover", "deep_crawl", "third_party", "extract"]


def curate(links: DataFrame, quotas: dict[str, int] = QUOTAS, most: int = 50) -> DataFrame:
    """The best of each type within its quota, then others by rank, most for each asset. links: asset_id, kind, link_id, rank."""
    cases = F.lit(quotas.get("other", 0))
    for k, n in quotas.items():
        cases = F.when(F.col("kind") == k, n).otherwise(cases)
    turn = F.row_number().over(Window.partitionBy("asset_id", "kind").orderBy("rank", "link_id"))
    rows = links.withColumn("in_quota", turn <= cases)
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("in_quota"), "rank", "link_id"))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def missing(assets: DataFrame, have: DataFrame, materials: list[str]) -> DataFrame:
    """asset_id and material for each of the fixed materials that an asset has nothing of."""
    want = assets.select("asset_id", F.explode(F.array(*map(F.lit, materials))).alias("material"))
    return want.join(have.select("asset_id", "material").distinct().hint("merge"), ["asset_id", "material"], "left_anti")


def fill_plan(gaps: DataFrame) -> DataFrame:
    """asset_id, step and action: the distinct actions for an asset's gaps in their fixed order."""
    action = F.lit(None).cast("string")
    for m, a in FILL_ACTIONS.items():
        action = F.when(F.col("material") == m, a).otherwise(action)
    step = F.array_position(F.array(*map(F.lit, ACTION_ORDER)), action).cast("int")
    return gaps.select("asset_id", step.alias("step"), action.alias("action")).filter("action is not null").distinct()


def social_composite(rows: DataFrame) -> DataFrame:
    """Adds score (weights renormalised over the dimensions there are), dims and confidence; none: not_found."""
    have = lambda c: F.when(F.col(c).isNotNull(), F.lit(SOCIAL_WEIGHTS[c])).otherwise(0.0)
    total = sum((have(c) for c in SOCIAL_WEIGHTS), F.lit(0.0))
    score = F.try_divide(sum((have(c) * F.coalesce(F.col(c), F.lit(0.0)) for c in SOCIAL_WEIGHTS), F.lit(0.0)), total)
    dims = sum((F.col(c).isNotNull().cast("int") for c in SOCIAL_WEIGHTS), F.lit(0))
    confidence = F.when(dims == 4, "high").when(dims >= 2, "medium").when(dims == 1, "low").otherwise("not_found")
    return rows.withColumns({"score": score, "dims": dims, "confidence": confidence})


def sentiment_class(mean: Column) -> Column:
    """positive above 65, negative below 35. What a mean has beyond 9 digits is left by the order of its sum, and decides nothing."""
    s = F.round(mean, 9)
    return F.when(s > 65, "positive").when(s < 35, "negative").otherwise("neutral")


def watch_alerts(rows: DataFrame, as_of: Column, lead: Column, drop_pct: float = 15.0) -> DataFrame:
    """Rows that need an alert: an unlock within its lead days and not sent, or a drop of drop_pct or more.

    Columns: target_date, entry_price, last_price, alert_sent. Adds days_to, drop, unlock_alert, drop_alert.
    """
    days = F.datediff("target_date", as_of)
    drop = F.try_divide(F.col("last_price"), F.col("entry_price")) - 1
    unsent = F.col("alert_sent").isNull()
    out = rows.withColumns({"days_to": days, "drop": drop})
    out = out.withColumn("unlock_alert", F.coalesce((F.col("days_to") >= 0) & (F.col("days_to") <= lead) & unsent, F.lit(False)))
    out = out.withColumn("drop_alert", F.coalesce((F.col("drop") <= -drop_pct / 100) & unsent, F.lit(False)))
    return out.filter("unlock_alert or drop_alert")


def post_type(model: Column, entered: Column, pnl: Column) -> Column:
    """The model's type unless the post says that the trade was made or shows its result."""
    return F.when(F.coalesce(entered, F.lit(False)) | F.coalesce(pnl, F.lit(False)), "after_action").otherwise(model)


def to_alert(kind: Column, entered: Column, confidence: Column, least: float = 0.8) -> Column:
    return (kind == "prediction") & ~F.coalesce(entered, F.lit(False)) & (confidence >= least)


def valid_citations(answer: Column, sources: Column) -> Column:
    """Distinct numbers in brackets that name one of the sources (1 to their number), sorted."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= sources))))

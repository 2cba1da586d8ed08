"""The questions that can be asked about one asset or all, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.models import with_answers
from marlstone.operators import retrieval, trigram
from marlstone.plans.catalogue import QUERIES
from marlstone.plans.entity_queries import competitors, listed, search_text
from marlstone.plans.market_queries import tier_pairs
from marlstone.plans.retrieval_queries import library
from marlstone.plans.selection_queries import in_tier
from marlstone.plans.thesis_queries import PARTS, facts, signs

#: Name -> the query with its rows, and the column that names the asset (none: about all assets).
ENDPOINTS: dict[str, tuple[str, str | None]] = {
    "competitors": ("sector_competitors", "target"), "competitor-metrics": ("competitor_metrics", "target"), "divergence": ("divergence_from_tables", "asset_id"), "derivatives": ("asset_derivatives", "asset_id"),
    "derivatives-history": ("derivatives_history", "asset_id"), "cex-netflow": ("cex_netflow", "asset_id"), "whale-flow": ("whale_from_tables", "asset_id"), "holder-trend": ("holder_trend", "chain"),
    "search": ("search_ranked", None), "market-history": ("market_history_30d", "asset_id"), "signals": ("signals_from_tables", "asset_id"),
    "event-impact": ("event_impact", "asset_id"), "correlation-matrix": ("correlation_pairs", None), "leaderboard": ("leaderboard", None),
    "coverage-by-tier": ("coverage_by_tier", None), "backtest": ("recommendation_backtest", None), "sector-heatmap": ("sector_heatmap", None),
    "notebook": ("missing_materials", "asset_id"), "evidence": ("evidence_by_type", "asset_id"), "thesis": ("thesis_facts", "asset_id"), "stance": ("thesis_stance", "asset_id"),
    "recommendations": ("recommendations_archived", "asset_id"), "unified": ("unified_assets", None),
}


def ask(spark: SparkSession, folder: str, name: str, asset: int | None = None, text: str | None = None, tier: str | None = None, index: trigram.AssetIndex | None = None) -> DataFrame:
    """The rows of an endpoint, for one asset where it has a column for it: the filter reaches the scan.

    text is searched for, in the stored postings of index if given; tier keeps the assets of a market tier: of a search,
    the leaderboard and the coverage, and for the correlation matrix those of the tier alone are multiplied.
    """
    query, column = ENDPOINTS[name]
    if name == "correlation-matrix" and tier is not None:
        return tier_pairs(spark, folder, tier)
    if name == "search" and text is not None:
        rows = trigram.search(index, text).drop("rank") if index else listed(spark, folder)
        return search_text(spark, folder, text, rows if tier is None else in_tier(rows, spark, folder, tier))
    run: Callable = competitors if name == "competitors" else QUERIES[query]
    rows = run(spark, folder)
    if tier is not None and "tier" in rows.columns:
        rows = rows.filter(F.col("tier") == tier)
    elif tier is not None:
        rows = in_tier(rows, spark, folder, tier)
    return rows if asset is None or column is None else rows.filter(F.col(column) == asset)


def answer(spark: SparkSession, folder: str, questions: DataFrame, k: int = 5, index: retrieval.TextIndex | None = None, model: Callable[[list[str]], list[str]] = retrieval.extractive) -> DataFrame:
    """question, answer and citations of questions (question, text) on the collected documents, or on a stored index of them."""
    return retrieval.answers(index or library(spark, folder), questions, k, model)


def thesis_inputs(spark: SparkSession, folder: str, asset: int) -> DataFrame:
    """part, metric and value: what a written thesis on an asset starts from, its four parts' signs included."""
    own = facts(spark, folder).filter(F.col("asset_id") == asset).select("part", "metric", "value")
    return own.unionByName(signs(spark, folder).filter((F.col("asset_id") == asset) & F.col("sign").isNotNull()).select("part", F.lit("sign").alias("metric"), F.col("sign").alias("value")))


def thesis(spark: SparkSession, folder: str, asset: int, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """part, figures and text: for each of the four parts its figures, and what a model writes of them; a part without figures says so and is not written."""
    rows = thesis_inputs(spark, folder, asset).groupBy("part").agg(F.array_sort(F.collect_list(F.concat_ws("=", "metric", F.round("value", 6).cast("string")))).alias("figures"))
    every = spark.createDataFrame([(p,) for p in PARTS], "part string").join(rows, "part", "left").withColumn("figures", F.coalesce("figures", F.array().cast("array<string>")))
    written = with_answers(every.withColumn("prompt", F.concat(F.lit("Only from these figures, on "), "part", F.lit(": "), F.array_join("figures", ", "))), "prompt", "text", **({"model": model} if model else {}))
    return written.select("part", "figures", F.when(F.size("figures") > 0, F.col("text")).otherwise("no figures").alias("text"))

"""How rows come in: from third parties' details, in stages of classification, and where a search finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.models import clamped
from marlstone.operators import entities, links

DETAIL = "audit_links array<string>, raises array<struct<round: string, amount: double>>, hacks array<struct<kind: string, amount: double>>"
# Source types that a curated list leaves out, ends of addresses that are no pages, first materials of a crawl.
SOCIAL = ["twitter", "reddit", "telegram"]
FILE_ENDS = r"(?i)\.(pdf|png|jpe?g|gif|svg|webp|ico|mp4|zip)([?#].*)?$"
CRAWL_FIRST = ["official_website", "docs"]


def mapped(details: DataFrame, ids: DataFrame) -> DataFrame:
    """asset_id and detail of protocols' landed JSON (protocol_id, body); those of no asset (ids: protocol_id, asset_id) are skipped."""
    return details.join(ids, "protocol_id").select("asset_id", F.from_json("body", DETAIL).alias("detail"))


def audit_links(rows: DataFrame) -> DataFrame:
    """A link of topic audit for each distinct address among an asset's audits."""
    out = rows.select("asset_id", F.explode("detail.audit_links").alias("url")).filter("url is not null").distinct()
    return out.withColumn("topic", F.lit("audit"))


def raises(rows: DataFrame) -> DataFrame:
    """rounds and raised of each asset with a round; rounds without an amount count."""
    out = rows.select("asset_id", F.explode("detail.raises").alias("r"))
    return out.groupBy("asset_id").agg(F.count("*").alias("rounds"), F.sum("r.amount").alias("raised"))


def hacks(rows: DataFrame) -> DataFrame:
    return rows.select("asset_id", F.inline("detail.hacks"))


def backlog(rows: DataFrame) -> DataFrame:
    """Links that no stage has classified."""
    return rows.filter(F.col("topics").isNull())


def low_confidence(rows: DataFrame) -> DataFrame:
    """Links that rules gave their default, for a model that reads the body."""
    return rows.filter(F.col("method") == "default")


def backfill(rows: DataFrame) -> DataFrame:
    """Classifies the backlog by address and url_key; links that have topics stay as they are. rows: url, url_key, topics, method, confidence."""
    c = F.when(F.col("topics").isNull(), links.classify(F.col("url"), F.col("url_key")))
    new = {x: F.when(F.col("topics").isNull(), c[x]).otherwise(F.col(x)) for x in ("method", "confidence", "topics")}
    return rows.withColumns(new)


def read_bodies(rows: DataFrame, answers: DataFrame, key: str = "link_id") -> DataFrame:
    """Links of low confidence with a model's topics, confidence and reason; no answer: ai_failed, for a browser. Others stay.

    answers: key, ai_topics, ai_confidence, reason, one row of each key; has_body says whether the body was read, which
    it was without the column. A model's confidence is kept within the band of what it has seen.
    """
    low = F.coalesce(F.col("method") == "default", F.lit(False))
    good = low & F.col("ai_topics").isNotNull()
    both = rows.join(answers, key, "left")
    return both.select(
        *[c for c in rows.columns if c not in ("method", "confidence", "topics")],
        F.when(good, F.lit("ai_content")).when(low, F.lit("ai_failed")).otherwise(F.col("method")).alias("method"),
        F.when(good, clamped(F.col("ai_confidence"), F.coalesce(F.col("has_body"), F.lit(False)) if "has_body" in answers.columns else F.lit(True))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(good, F.col("ai_topics")).otherwise(F.col("topics")).alias("topics"),
        F.when(good, F.col("reason")).alias("reason"), (low & ~good).alias("needs_browser"),
    )


def for_curation(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Links without those to social networks; links of unknown kind stay."""
    return rows.filter(~F.coalesce(F.col(kind).isin(*SOCIAL), F.lit(False)))


def pages_only(rows: DataFrame, url: str = "url") -> DataFrame:
    """Links that may be pages: no documents, images or archives by the end of the address."""
    return rows.filter(~F.col(url).rlike(FILE_ENDS))


def crawl_rank(material: Column) -> Column:
    """Place in the order of a crawl: the site, its documents, then the rest."""
    place = F.array_position(F.array(*map(F.lit, CRAWL_FIRST)), material).cast("int")
    return F.when(place > 0, place).otherwise(len(CRAWL_FIRST) + 1)


def short_origin(origin: Column, most: int = 64) -> Column:
    """What a link was found from, cut to the column's width."""
    return F.substring(origin, 1, most)


def since(rows: DataFrame, key: str, mark) -> DataFrame:
    """Rows from a water mark of the key on; the filter reaches the scan."""
    return rows.filter(F.col(key) >= mark)


def new_links(rows: DataFrame, time: str, day: Column) -> DataFrame:
    """n of the links that an asset got on a day."""
    return rows.filter(F.to_date(time) == day).groupBy("asset_id").agg(F.count("*").alias("n"))


def host_sets(rows: DataFrame) -> DataFrame:
    """asset_id and its distinct hosts, sorted, for one judgement of all; hosts are as few as sites that an asset links to."""
    pairs = rows.select("asset_id", "host").filter("host <> ''").distinct()
    return pairs.groupBy("asset_id").agg(F.array_sort(F.collect_list("host")).alias("hosts"))


def found_or_listed(core: DataFrame, listing: DataFrame, q: str) -> DataFrame:
    """Matches of q in core or, if there are none, those in a listing that core lacks: they have inserted set.

    Both: asset_id, symbol, name, contract. One row at most says that core has a match, so its join is small.
    """
    own = entities.search(core, q)
    some = own.limit(1).select(F.lit(1).alias("some"))
    other = entities.search(listing, q).join(core.select("asset_id"), "asset_id", "left_anti").withColumn("some", F.lit(1))
    other = other.join(some, "some", "left_anti").drop("some")
    return own.withColumn("inserted", F.lit(False)).unionByName(other.withColumn("inserted", F.lit(True)))


def unlock_source(rows: DataFrame, have: dict[str, Column], needed: list[str]) -> DataFrame:
    """rows with tier, the first source in the order of have that has an unlock plan, and missing.

    Without any, a model works one out from the needed figures: tier is model where all are there, else refused, with
    the names of those that are missing; a model is never asked without them.
    """
    tier = F.lit(None).cast("string")
    for name, condition in reversed(have.items()):
        tier = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(tier)
    lacking = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]), lambda x: x.isNotNull())
    missing = F.when(tier.isNull(), lacking).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"tier": F.coalesce(tier, F.when(F.size(lacking) == 0, "model").otherwise("refused")), "missing": missing})

"""Links: normal form, hosts, classification, noise, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.storage import stored

# Host -> source type, key -> source type, word -> topic.
HOST_TYPES = {
    "github.com": "github", "medium.com": "medium", "x.com": "twitter", "twitter.com": "twitter", "t.me": "telegram",
    "reddit.com": "reddit", "facebook.com": "facebook", "docs.google.com": "docs",
}
KEY_TYPES = {"website": "official_website", "technical_doc": "docs", "source_code": "github", "message_board": "medium", "announcement": "announcement", "chat": "telegram"}
TOPIC_WORDS = {
    "whitepaper": ["whitepaper", "white paper", "litepaper"], "docs": ["docs", "documentation", "developer"], "audit": ["audit", "security review"],
    "tokenomics": ["tokenomics", "token economics"], "roadmap": ["roadmap", "milestone"], "research": ["research", "report"],
    "announcement": ["announcement", "news", "blog"], "team_vc": ["team", "investor"], "dao_governance": ["governance", "dao", "proposal"], "bug_bounty": ["bounty"],
}
SPA_MARKS = r"id=[\"'](?:root|app|__next|__nuxt)[\"']|react-dom|vue(?:\.min)?\.js|__NUXT__|__NEXT_DATA__"


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no utm parameters, no closing slash."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, r"([?&])utm_[^&]*&", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"([?&])utm_[^&]*&", "$1"), r"[?&]utm_[^&]*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.regexp_replace(F.concat(head, rest), "/+$", "")


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)), r"^www\.", "")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), F.lit(1))


def absolute(base: Column, link: Column) -> Column:
    """A link as an absolute address: others' schemes stay, a leading slash starts at the host, the rest at the page's folder."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_text(html: Column) -> Column:
    """The text between tags: scripts, styles and comments first, then tags, then white space."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " "))


def lookup(column: Column, values: dict[str, str]) -> Column:
    """The value of a key in a small fixed table."""
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()]), lambda x: x["k"] == column), F.lit(0))["v"]


def classify(url: Column, url_key: Column) -> Column:
    """method, confidence, source_type and topics: by host, then by the source's key, then by words, else other."""
    words = F.translate(F.lower(url), "-_", "  ")
    found = F.filter(
        F.array(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(words, w)), F.lit(t)) for t, ws in TOPIC_WORDS.items()]), lambda x: x.isNotNull()
    )
    by_host, by_key = lookup(host_of(url), HOST_TYPES), lookup(url_key, KEY_TYPES)
    as_row = lambda m, c, s, t: F.struct(F.lit(m).alias("method"), F.lit(c).alias("confidence"), s.alias("source_type"), t.alias("topics"))
    other = F.array(F.lit("other"))
    topics = F.when(F.size(found) > 0, found).otherwise(other)
    return (
        F.when(by_host.isNotNull(), as_row("domain", 0.98, by_host, topics))
        .when(by_key.isNotNull(), as_row("url_key", 0.9, by_key, topics))
        .when(F.size(found) > 0, as_row("keyword", 0.6, F.lit("other"), found))
        .otherwise(as_row("default", 0.3, F.lit("other"), other))
    )


def is_spa(html: Column, n_links: Column, small: int = 5000) -> Column:
    """Pages that need a browser: no links, and few bytes or a framework's mark."""
    return (n_links == 0) & ((F.octet_length(html) < small) | html.rlike(SPA_MARKS))


def noise(links: DataFrame, dense: int = 5, many: int = 100, share: float = 0.9, assets: int = 50) -> DataFrame:
    """host counts of each asset and what they imply: dense, dominant, shared. links: asset_id, host.

    Counts combine before the shuffle, so an asset or host with most of the links is a few rows.
    """
    n = links.groupBy("asset_id", "host").agg(F.count("*").alias("links"))
    all_of = F.sum("links").over(Window.partitionBy("asset_id"))
    n = n.withColumn("share", F.col("links") / all_of)
    spread = n.groupBy("host").agg(F.count("*").alias("assets"))
    return n.join(spread, "host").select(
        "asset_id", "host", "links", "share", "assets", (F.col("links") > dense).alias("dense"),
        ((F.col("links") > many) & (F.col("share") > share)).alias("dominant"), (F.col("assets") > assets).alias("shared"),
    )


def keep_links(links: DataFrame, blocked: list[str], noisy: list[str], trusted: list[str]) -> DataFrame:
    """Drops blocked and noisy hosts unless trusted or the address names the asset. links: url, host, symbol, name."""
    tokens = F.filter(F.split(F.lower(F.concat_ws(" ", "symbol", "name")), "[^a-z0-9]+"), lambda t: F.char_length(t) > 2)
    named = F.exists(tokens, lambda t: F.contains(F.lower(F.col("url")), t))
    bad = F.col("host").isin(*blocked, *noisy) if blocked or noisy else F.lit(False)
    good = F.col("host").isin(*trusted) if trusted else F.lit(False)
    return links.filter(~bad | good | F.coalesce(named, F.lit(False)))


def cleaned(links: DataFrame, verdicts: DataFrame, aggregators: list[str], noisy: list[str], audits: list[str], dense: int = 5, many: int = 100, share: float = 0.9, assets: int = 50) -> DataFrame:
    """The links with layer and kept: which layer of noise cleaning decides on each.

    links: asset_id, host, url, symbol, name; verdicts: asset_id and host of what a model took for noise of an asset.
    aggregator: the host is one, dropped. crowd: an audit host has more than dense links of the asset, and this one does
    not name it, dropped. rule: a noisy host that is no audit host, dropped. Of what the model took for noise: audit
    hosts stay (audit), hosts of more than assets assets stay, as the model erred (shared), a host with more than many
    links and more than share of its asset's is judged again (reset, kept until then), the rest is dropped (model).
    Others are kept. A null host is no site, and stays.
    """
    counts = noise(links.filter("host is not null and asset_id is not null").select("asset_id", "host"), dense, many, share, assets).withColumnsRenamed({"asset_id": "_asset", "host": "_host"})
    judged = verdicts.select(F.col("asset_id").alias("_a"), F.col("host").alias("_h")).distinct().withColumn("_noise", F.lit(True))
    facts = counts.join(judged, (F.col("_asset") == F.col("_a")) & (F.col("_host") == F.col("_h")), "left")
    facts = stored(facts.select("_asset", "_host", F.col("links").alias("_links"), "dense", "dominant", "shared", "_noise"), "link-facts")
    # A row for each asset and host. The pairs with more links than an average shuffle partition, fewer than there are
    # partitions, are broadcast, and their links stay where they are; the others are shuffled.
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum("_links")).first()[0] or 0
    hot, rest = (facts.filter(c).drop("_links") for c in (F.col("_links") * parts > total, F.col("_links") * parts <= total))
    on = (F.col("asset_id") == F.col("_asset")) & (F.col("host") == F.col("_host"))
    site = F.col("host").isNotNull() & F.col("asset_id").isNotNull()
    none = [F.lit(None).cast("boolean").alias(c) for c in ("dense", "dominant", "shared", "_noise")]
    columns = [*links.columns, "dense", "dominant", "shared", "_noise"]
    rows = links.filter(site).join(F.broadcast(hot), on).select(columns)
    cool = links.filter(site).join(F.broadcast(hot.select("_asset", "_host")), on, "left_anti")
    rows = rows.unionByName(cool.join(rest, on).select(columns)).unionByName(links.filter(~site).select("*", *none))
    tokens = F.filter(F.split(F.lower(F.concat_ws(" ", "symbol", "name")), "[^a-z0-9]+"), lambda t: F.char_length(t) > 2)
    named = F.coalesce(F.exists(tokens, lambda t: F.contains(F.lower(F.col("url")), t)), F.lit(False))
    of = lambda hosts: F.col("host").isin(*hosts) if hosts else F.lit(False)
    layer = (
        F.when(F.col("host").isNull(), "kept").when(of(aggregators), "aggregator").when(of(audits) & F.col("dense") & ~named, "crowd").when(of(noisy) & ~of(audits), "rule")
        .when(F.col("_noise").isNull(), "kept").when(of(audits), "audit").when(F.col("dominant"), "reset").when(F.col("shared"), "shared").otherwise("model")
    )
    out = rows.withColumn("layer", layer).select(*links.columns, "layer")
    return out.withColumn("kept", ~F.col("layer").isin("aggregator", "crowd", "rule", "model"))

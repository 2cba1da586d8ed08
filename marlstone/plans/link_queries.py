"""Queries on pages and their links."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import links
from marlstone.plans.registry import query
from marlstone.sources.tables import table

NORM = r"""regexp_replace({head} || {rest}, '/+$', '')"""
UTM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[^&]*&', '\1', 'g'), '([?&])utm_[^&]*&', '\1', 'g'), '[?&]utm_[^&]*$', '', 'g')"
NORMAL = rf"regexp_replace(lower(regexp_extract({UTM}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || regexp_replace({UTM}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '/+$', '')"
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '^www\.', '')"


@query(f"select page_id, {NORMAL} as url_norm from pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", links.normal_url(F.col("url")).alias("url_norm"))


@query(f"select {NORMAL} as url_norm, min(page_id) as page_id from pages group by 1")
def url_dedup(spark, d):
    return table(spark, d, "pages").groupBy(links.normal_url(F.col("url")).alias("url_norm")).agg(F.min("page_id").alias("page_id"))


@query(f"select {HOST} as host, count(*) as pages from pages group by 1")
def domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(links.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


LINKS = rf"""
p as (select page_id, url, {HOST} as host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as site,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder,
  unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)', 1)) as link from pages),
l as (select page_id, host, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then link when link like '//%' then regexp_extract(url, '^([A-Za-z]+:)', 1) || link
  when link like '/%' then site || link else site || (case when folder = '' then '/' else folder end) || link end as url from p)"""


def found(spark, d):
    pages = table(spark, d, "pages")
    rows = pages.select("page_id", "url", F.explode(links.hrefs(F.col("html"))).alias("link"))
    return rows.select("page_id", links.host_of(F.col("url")).alias("page_host"), links.absolute(F.col("url"), F.col("link")).alias("url"))


@query(f"with {LINKS} select page_id, url, count(*) as n from l group by 1, 2")
def link_extract(spark, d):
    return found(spark, d).groupBy("page_id", "url").agg(F.count("*").alias("n"))


def _topics(column: str) -> str:
    cases = ", ".join(f"case when {' or '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in ws)} then '{t}' end" for t, ws in links.TOPIC_WORDS.items())
    return f"list_filter([{cases}], lambda x: x is not null)"


def _case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


KEY = "case page_id % 7 when 0 then 'website' when 1 then 'technical_doc' when 2 then 'source_code' end"


@query(f"""with x as (select page_id, url, {HOST} as host, {KEY} as k, {_topics("translate(lower(url), '-_', '  ')")} as t from pages),
y as (select *, {_case("host", links.HOST_TYPES)} as by_host, {_case("k", links.KEY_TYPES)} as by_key from x)
select page_id, case when by_host is not null then 'domain' when by_key is not null then 'url_key' when len(t) > 0 then 'keyword' else 'default' end as method,
  case when by_host is not null then 0.98 when by_key is not null then 0.9 when len(t) > 0 then 0.6 else 0.3 end :: double as confidence,
  coalesce(by_host, by_key, 'other') as source_type, case when len(t) > 0 then array_to_string(t, ',') else 'other' end as topics from y""")
def classify_links(spark, d):
    k = F.col("page_id") % 7
    key = F.when(k == 0, "website").when(k == 1, "technical_doc").when(k == 2, "source_code")
    rows = table(spark, d, "pages").select("page_id", links.classify(F.col("url"), key).alias("c"))
    return rows.select("page_id", "c.method", "c.confidence", "c.source_type", F.array_join("c.topics", ",").alias("topics"))


NOISE = f"""
base as (select page_id % 10 as asset_id, {HOST} as host from pages),
n as (select asset_id, host, count(*) as links from base group by 1, 2),
s as (select *, links / sum(links) over (partition by asset_id) as share, count(*) over (partition by host) as assets from n)"""


def host_noise(spark, d):
    rows = table(spark, d, "pages").select((F.col("page_id") % 10).alias("asset_id"), links.host_of(F.col("url")).alias("host"))
    return links.noise(rows, dense=2, many=3, share=0.1, assets=3)


@query(f"with {NOISE} select asset_id, host, links from s where links > 2")
def noise_density(spark, d):
    return host_noise(spark, d).filter("dense").select("asset_id", "host", "links")


@query(f"with {NOISE} select asset_id, host, links, round(share, 8) as share, links > 3 and share > 0.1 as dominant, assets > 3 as shared from s")
def noise_dominance(spark, d):
    return host_noise(spark, d).select("asset_id", "host", "links", F.round("share", 8).alias("share"), "dominant", "shared")


@query(r"""select page_id, octet_length(encode(html)) as bytes, len(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)', 1)) as links,
len(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]+)', 1)) = 0 and (octet_length(encode(html)) < 5000 or regexp_matches(html, 'id=["''](?:root|app|__next|__nuxt)["'']|react-dom|vue(?:\.min)?\.js|__NUXT__|__NEXT_DATA__')) as needs_browser from pages""")
def spa_pages(spark, d):
    n = F.size(links.hrefs(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), n.cast("long").alias("links"), links.is_spa(F.col("html"), n).alias("needs_browser"))


@query(r"""with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from pages),
u as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from t)
select page_id, trim(regexp_replace(t, '[ \t\n\r\f\x0B]+', ' ', 'g')) as body from u""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", links.page_text(F.col("html")).alias("body"))


@query(f"""with x as (select page_id, url, {HOST} as host from pages)
select page_id, host from x where not (page_id % 5 = 0 and contains(host, 'e')) or contains(lower(url), 'page')""")
def noise_clean(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", links.host_of(F.col("url")).alias("h"))
    marked = rows.withColumns({
        "host": F.when((F.col("page_id") % 5 == 0) & F.contains(F.col("h"), F.lit("e")), F.lit("aggregator.example")).otherwise(F.col("h")),
        "symbol": F.lit("page"), "name": F.lit(None).cast("string"),
    })
    return links.keep_links(marked, ["aggregator.example"], [], []).select("page_id", F.col("h").alias("host"))

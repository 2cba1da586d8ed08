"""Tables and sections read back out of pages that hold them, and pages found by slug."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import extract
from marlstone.plans.registry import query
from marlstone.sources.tables import table


def holder_pages(spark, d):
    """A page of each nation with its customers as a table of holders, inside the landed pages; pages of no nation have no table."""
    row = F.concat(
        F.lit("<tr class=x>\n<td>"), F.col("r").cast("string"), F.lit("</td><td><a href='/a'>"), F.lit("0xAB"), F.col("c_custkey").cast("string"), F.lit("</a><td>"),
        F.format_number("c_acctbal", 2), F.lit("</td><td>"), F.col("c_nationkey").cast("string"), F.lit(".5%</td></tr>"),
    )
    c = table(spark, d, "customer").withColumn("r", F.col("c_custkey"))
    t = c.groupBy(F.col("c_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", row.alias("x")))), lambda x: x["x"]), "").alias("rows"))
    head = "<TABLE id=holders><thead><tr><th>Rank</th><th>Address</th><th>Quantity</th><th>Percentage</th></tr></thead><tbody>"
    p = table(spark, d, "pages").select("page_id", "html").join(t, "page_id", "left")
    return p.select("page_id", F.concat(F.lit("<!-- <table><tr><th>address<th>quantity</table> -->"), "html", F.when(F.col("rows").isNotNull(), F.concat(F.lit(head), "rows", F.lit("</tbody></TABLE>"))).otherwise("")).alias("html"))


@query("""select c_nationkey as page_id, c_custkey as rank, '0xab' || c_custkey as address, c_acctbal as quantity, round((c_nationkey + 0.5) / 100, 6) as share from customer where c_nationkey in (select page_id from pages)""")
def holder_tables(spark, d):
    """Every holder back from the tables of the pages."""
    rows, _ = extract.holder_rows(holder_pages(spark, d))
    return rows.withColumn("share", F.round("share", 6))


@query("select page_id, 'no table' as reason from pages where html is not null and page_id not in (select c_nationkey from customer)")
def pages_unread(spark, d):
    """The pages without a holder table, kept apart."""
    return extract.holder_rows(holder_pages(spark, d))[1]


TEXT = "trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"""with t as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null and not regexp_matches(text, '[<&]')),
h as (select doc_id, unnest(['overview', 'unlocks', 'revenue', 'valuation']) as section, unnest([l[1], l[2], l[3], l[4]]) as x from t)
select doc_id as page_id, section, {TEXT.format("x")} as text from h where {TEXT.format("x")} <> ''""")
def tokenomics_sections(spark, d):
    """The four sections of pages made of the first lines of each document; a section without text is none."""
    docs = table(spark, d, "documents").filter("text is not null and not rlike(text, '[<&]')").select("doc_id", F.split("text", "\n").alias("l"))
    heads = ["<h1>Token Overview</h1><p>", "<H2 class='a'>Unlock <b>schedule</b></H2>", "</p><h3>Fees &amp; revenue</h3><div>", "<script>'<h2>About</h2>'</script><h2>FDV</h2>"]
    line = lambda i: F.coalesce(F.get("l", F.lit(i)), F.lit(""))
    html = F.concat(F.lit("<body>before"), *[x for i, h in enumerate(heads) for x in (F.lit(h), line(i))], F.lit("</div><h4>Else</h4>after"))
    return extract.sections(docs.select(F.col("doc_id").alias("page_id"), html.alias("html")))


SLUG = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""with a as (select p_partkey as asset_id, {SLUG.format("case when p_size > 45 then p_name || ' ' || p_size end")} as c1, {SLUG.format("p_brand")} as c2, {SLUG.format("p_name")} as c3, {SLUG.format("p_brand || '-' || p_name")} as c5 from part),
s as (select asset_id, 1 as o, c1 as slug, 'source_id' as made_of from a union all select asset_id, 2, c2, 'symbol' from a union all select asset_id, 3, c3, 'name' from a union all select asset_id, 5, c5, 'symbol and name' from a),
p as (select {SLUG.format("p_name || ' ' || p_size")} as slug, min(p_partkey) as page_id from part where p_size > 47 group by 1 union all select {SLUG.format("p_name")}, min(p_partkey) from part where p_type = 'ECONOMY' group by 1),
m as (select asset_id, s.slug, made_of, page_id, o from s join p using (slug) qualify row_number() over (partition by asset_id order by o) = 1)
select asset_id, slug, made_of, page_id from m""")
def slug_pages(spark, d):
    """The page of each asset by its best slug: some pages are kept by id, some by name."""
    p = table(spark, d, "part")
    assets = p.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_size") > 45, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("source_id"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"))
    kept = p.filter("p_size > 47").select(extract.slug(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("slug"), F.col("p_partkey").alias("page_id"))
    pages = kept.unionByName(p.filter("p_type = 'ECONOMY'").select(extract.slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("page_id")))
    return extract.matched_slugs(assets, pages)[0].select("asset_id", "slug", "made_of", "page_id")

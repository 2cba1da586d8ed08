"""Tables and sections out of pages, by built-in expressions; names under which a site may keep an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.entities import normal_address
from marlstone.operators.links import page_text

#: Section of a tokenomics page -> words of its heading.
SECTIONS = {"overview": ["overview", "about", "summary"], "unlocks": ["unlock", "vesting", "release schedule"], "revenue": ["revenue", "fees", "earnings"], "valuation": ["valuation", "fdv", "market value"]}
#: A holder table's column -> words of its head.
HOLDER_COLUMNS = {"rank": ["rank", "#"], "address": ["address", "holder", "account"], "quantity": ["quantity", "balance", "amount"], "share": ["percentage", "share", "%"]}


def without_code(html: Column) -> Column:
    """Without comments, scripts and styles, whose tags are none of the page's."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " "), r"(?is)<(script|style)\b.*?</\1\s*>", " ")


def tables(html: Column) -> Column:
    """array<array<array<string>>>: the texts of the cells of the rows of each table; a table inside a cell ends its outer one."""
    found = F.regexp_extract_all(without_code(html), F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))
    # Row and cell end where the next one begins, as closing tags may be left out.
    rows = lambda t: F.slice(F.split(t, r"(?i)<tr\b[^>]*>"), 2, F.greatest(F.lit(1), F.char_length(t)))
    cells = lambda r: F.transform(F.slice(F.split(F.regexp_replace(r, r"(?is)</tr\s*>.*$", ""), r"(?i)<t[dh]\b[^>]*>"), 2, F.greatest(F.lit(1), F.char_length(r))), page_text)
    return F.transform(found, lambda t: F.filter(F.transform(rows(t), cells), lambda r: F.size(r) > 0))


def number(text: Column) -> Column:
    """A number as it is written on pages: thousands' commas, a sign of per cent or currency; null if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")


def holder_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unread): rank, address, quantity and share (of 1) of each row of the pages' holder tables, and the pages without any.

    pages: page_id, html. A table counts if its head names an address and a quantity; columns may stand in any order.
    A row counts if it has an address without white space; its rank is its place where the table has none. Pages whose
    tables have no such row are unread, with the reason: no page, no table, no holder table, no row.
    """
    low = lambda r: F.transform(r, F.lower)
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))

    def place(head: Column, words: list[str]) -> Column:
        """From 1; 0 for none."""
        hit = F.transform(head, lambda c: has(c, words))
        return F.array_position(hit, True).cast("int")

    table = lambda t: F.struct(*[place(low(F.get(t, F.lit(0))), w).alias(k) for k, w in HOLDER_COLUMNS.items()], F.slice(t, 2, F.greatest(F.lit(1), F.size(t))).alias("rows"))
    read = pages.select("page_id", F.col("html").isNull().alias("no_page"), tables(F.col("html")).alias("t"))
    read = read.withColumn("named", F.filter(F.transform("t", table), lambda x: (x["address"] > 0) & (x["quantity"] > 0)))
    cell = lambda r, i: F.when(i > 0, F.get(r, i - 1))
    made = lambda x: F.transform(x["rows"], lambda r, i: F.struct(
        F.coalesce(number(cell(r, x["rank"])).cast("long"), (i + 1).cast("long")).alias("rank"), normal_address(F.trim(cell(r, x["address"]))).alias("address"),
        number(cell(r, x["quantity"])).alias("quantity"), (number(cell(r, x["share"])) / 100).alias("share"),
    ))
    good = lambda r: F.coalesce(r["address"].rlike(r"^\S+$"), F.lit(False)) & r["quantity"].isNotNull()
    read = read.withColumn("rows", F.filter(F.flatten(F.transform("named", made)), good))
    rows = read.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")
    reason = F.when(F.col("no_page"), "no page").when(F.size("t") == 0, "no table").when(F.size("named") == 0, "no holder table").otherwise("no row")
    return rows, read.filter(F.size("rows") == 0).select("page_id", reason.alias("reason"))


def headed(html: Column) -> Column:
    """array<struct<title, text>>: what stands under each heading (h1 to h4), up to the next."""
    parts = F.split(without_code(html), r"(?i)<h[1-4]\b[^>]*>")
    parts = F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts)))
    title = lambda p: page_text(F.regexp_replace(p, r"(?is)</h[1-4]\s*>.*$", ""))
    text = lambda p: page_text(F.regexp_extract(p, r"(?is)</h[1-4]\s*>(.*)$", 1))
    return F.transform(parts, lambda p: F.struct(title(p).alias("title"), text(p).alias("text")))


def sections(pages: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """page_id, section and text: of each of the four sections that a page has, the text under its headings, in order.

    A heading belongs to the first section of which it holds a word, case apart; others to none. Sections without any
    text are left out: the page does not have them.
    """
    names = names or SECTIONS
    title = lambda h: F.lower(h["title"])

    def section(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, words in reversed(names.items()):
            out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(title(h), w)), k).otherwise(out)
        return out

    rows = pages.select("page_id", F.posexplode(headed(F.col("html"))).alias("n", "h")).withColumn("section", section(F.col("h"))).filter("section is not null and h.text <> ''")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("n", "h.text"))), lambda x: x["text"])
    return rows.groupBy("page_id", "section").agg(F.array_join(texts, "\n").alias("text"))


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends; null where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.when(out != "", out)


def slugs(assets: DataFrame) -> DataFrame:
    """asset_id, rank, slug and made_of: the names to try for each asset (asset_id, source_id, symbol, name), best first.

    The source's id comes first, then symbol, name, the name without its last word where that is a mere protocol, token,
    finance or network, and symbol with name; a slug is tried once, at its first place.
    """
    name = slug(F.col("name"))
    made = {
        "source_id": slug(F.col("source_id")), "symbol": slug(F.col("symbol")), "name": name, "short name": F.when(name.rlike("-(protocol|token|finance|network|coin)$"), F.regexp_replace(name, "-[^-]*$", "")),
        "symbol and name": F.concat_ws("-", slug(F.col("symbol")), F.when(slug(F.col("symbol")).isNotNull(), name)),
    }
    rows = F.filter(F.array(*[F.struct(c.alias("slug"), F.lit(k).alias("made_of")) for k, c in made.items()]), lambda x: x["slug"].isNotNull() & (x["slug"] != ""))
    own = F.transform(rows, lambda x: x["slug"])
    first = F.filter(rows, lambda x, i: F.array_position(own, x["slug"]) == i + 1)
    return assets.select("asset_id", F.posexplode(first).alias("n", "s")).select("asset_id", (F.col("n") + 1).alias("rank"), "s.slug", "s.made_of")


def matched_slugs(assets: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): each asset with the page (slug, page_id) of its best-ranked slug that has one, and the assets without.

    Of several pages of a slug the least page_id counts.
    """
    own = pages.groupBy("slug").agg(F.min("page_id").alias("page_id"))
    best = slugs(assets).join(own, "slug").groupBy("asset_id").agg(F.min(F.struct("rank", "slug", "made_of", "page_id")).alias("b")).select("asset_id", "b.*")
    return best, assets.join(best.select("asset_id"), "asset_id", "left_anti")

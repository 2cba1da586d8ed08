"""Personal data: typed patterns, then bootstrapped extraction by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.text import fresh, row_key
from marlstone.storage import stored

#: A character that no pattern below contains marks the matches.
MARK, INSTEAD = "\x01", "\x02"
#: Order of kinds that start at the same place.
KINDS = ["email", "ip", "card", "phone", "secret"]
# Each finds what its plain form finds; possessive quantifiers and look-behinds only spare the retries that
# can't match, so that long runs take linear time and no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a valid match.
NEEDS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
#: Tokens that look like identifiers: a digit among six characters or more; and the seeds among them.
TOKEN = r"(?<![^\s\"'=:,;()<>\[\]{}])(?=[^\s\"'=:,;()<>\[\]{}]{6})[^\s\"'=:,;()<>\[\]{}0-9]*+[0-9][^\s\"'=:,;()<>\[\]{}]*+"
SEED = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"
#: A context has the three last words to the left, the one that the value is attached to included, and of each its
#: last characters; shorter matches than five characters there are none, so that many pieces hold them all.
WORDS, CHARS = 3, 40
PIECES = 2 * (WORDS * CHARS // 5 + 2)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.char_length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    return (
        F.when(kind == "ip", value.rlike(OCTETS))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _tail(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n)


def last_words(text: Column) -> Column:
    """The last words of a piece of text and one more, white space at either end as an empty word there."""
    return F.transform(_tail(F.split(text, r"\s+"), WORDS + 1), lambda w: F.right(w, F.lit(CHARS)))


def joined(a: Column, b: Column) -> Column:
    """The last words of two pieces, one after the other: the last word of a goes on in the first of b."""
    middle = F.right(F.concat(F.element_at(a, -1), F.element_at(b, 1)), F.lit(CHARS))
    whole = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(middle), F.slice(b, 2, F.size(b)))
    return F.when(F.size(b) > WORDS, b).otherwise(_tail(whole, WORDS + 1))


def matches(docs: DataFrame) -> DataFrame:
    """k, kind, start, end, value and before (the last words left of it, other matches included) of each match of each pattern.

    kind "token" has the identifier-like tokens. A text is scanned once for each pattern that it can match;
    places are sums of the lengths between matches, taken over the matches of one text and kind.
    """
    text = F.translate(F.coalesce("text", F.lit("")), MARK, INSTEAD)
    df = docs.select(row_key().alias("k"), text.alias("text"))
    kind_of = "array<struct<kind:string,j:int,gap:int,before:array<string>,value:string>>"

    def pieces(kind: str, pattern: str, needs: str) -> Column:
        marked = F.split(F.regexp_replace(F.col("text"), pattern, f"{MARK}$0{MARK}"), MARK)
        return F.when(F.col("text").rlike(needs), marked).alias(kind)

    df = df.select("k", *[pieces(x, p, NEEDS[x]) for x, p in PATTERNS.items()], pieces("token", TOKEN, "[0-9]"))

    def rows(kind: str) -> Column:
        p = F.col(kind)
        n = (F.size(p) - 1) / 2

        def before(j: Column) -> Column:
            """The gap's words, if it has enough, else those of the last pieces up to it."""
            own, first = last_words(F.get(p, 2 * j)), F.greatest(F.lit(1), 2 * j + 2 - PIECES)
            many = F.aggregate(F.slice(p, first, 2 * j + 2 - first), F.array(F.lit("")), lambda a, x: joined(a, last_words(x)))
            return _tail(F.when((j == 0) | (F.size(own) > WORDS), own).otherwise(many), WORDS)

        made = F.transform(
            F.sequence(F.lit(0), n.cast("int") - 1),
            lambda j: F.struct(
                F.lit(kind).alias("kind"),
                j.alias("j"),
                F.char_length(F.get(p, 2 * j)).alias("gap"),
                before(j).alias("before"),
                F.get(p, 2 * j + 1).alias("value"),
            ),
        )
        return F.when(F.size(p) >= 3, made).otherwise(F.array().cast(kind_of))

    df = df.select("k", F.explode_outer(F.concat(*[rows(x) for x in [*PATTERNS, "token"]])).alias("m"))
    df = df.select("k", "m.*").filter("value is not null").dropDuplicates(["k", "kind", "j"])
    before = Window.partitionBy("k", "kind").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("value")
    end = F.sum(F.col("gap") + size).over(before)
    return df.select("k", "kind", (end - size).alias("start"), end.alias("end"), "value", "before")


def contexts(before: Column) -> Column:
    """Lexical patterns left of an identifier: what is attached to it, and one or two words more, digits as zeros; white space counts as one space."""
    words = F.transform(before, lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0"))
    n = F.size(words)
    # An empty first word is the text's start or white space.
    last = lambda k: F.when((n >= k) & ((F.get(words, n - k) != "") | F.lit(k == 1)), F.array_join(F.slice(words, -k, k), " "))
    patterns = F.array(last(1), *[F.when(n >= k, last(k)) for k in range(2, WORDS + 1)])
    return F.filter(F.array_distinct(patterns), lambda x: x.rlike(r"[a-z0].*[=:#\"]|[a-z]\s"))


def bootstrap(edges: DataFrame, rounds: int = 3, min_score: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """pattern, kind and score of the patterns to trust.

    edges: pattern, value, kind (null unless a seed). A pattern's score for a kind is the mean score of its
    instances, smoothed by one unknown more; an instance that is no seed gets the score of its best trusted
    pattern. A pattern counts once min_seeds distinct instances speak for it.
    """
    edges = stored(edges.distinct(), "pii-edges")
    held = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("s", F.lit(1.0))
    trusted = None
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    for _ in range(rounds):
        by = edges.select("pattern", "value").distinct().join(held, "value").groupBy("pattern", "kind").agg(
            F.sum("s").alias("s"), F.count("*").alias("seeds")
        )
        best = by.groupBy("pattern").agg(F.max(F.struct("s", "seeds", "kind")).alias("b")).join(sizes, "pattern")
        scored = best.select("pattern", "b.kind", "b.seeds", (F.col("b.s") / (F.col("n") + 1)).alias("score"))
        trusted = stored(scored.filter((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)), "pii-patterns")
        new = edges.filter("kind is null").join(trusted.select("pattern", F.col("kind").alias("k2"), "score"), "pattern")
        new = new.groupBy("value").agg(F.max(F.struct("score", "k2")).alias("b")).select("value", F.col("b.k2").alias("kind"), F.col("b.score").alias("s"))
        seeds = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("s", F.lit(1.0))
        held = stored(seeds.unionByName(new.join(seeds.select("value").distinct(), "value", "left_anti")), "pii-instances")
    return trusted


def personal_data(docs: DataFrame, rounds: int = 3, min_score: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """k, kind, start, end (code points, end exclusive), value and base of each span found.

    base: matches of the typed patterns that are valid. Others are tokens that stand in a context that seeds
    (base matches, long hexadecimal tokens) have taught, and that overlap no base span. Null text is empty; very long
    texts are scanned whole; equal rows get equal spans; columns but doc_id and text play no part; an empty table has none.
    """
    found = stored(matches(docs), "pii-matches")
    typed = found.filter("kind != 'token'")
    base = typed.filter(valid(F.col("kind"), F.col("value")))
    taken = base.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    tokens = found.filter("kind = 'token'").join(taken, "k", "left")
    free = ~F.exists(F.coalesce("taken", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start")))
    tokens = tokens.filter(free).drop("taken").withColumn("seed", F.when(F.col("value").rlike(SEED), F.lit("secret")))
    tokens = stored(tokens.withColumn("patterns", contexts(F.col("before"))), "pii-tokens")
    edges = tokens.select(F.explode_outer("patterns").alias("pattern"), "value", F.col("seed").alias("kind")).unionByName(
        base.select(F.explode_outer(contexts(F.col("before"))).alias("pattern"), "value", "kind")
    ).filter("pattern is not null")
    trusted = bootstrap(edges, rounds, min_score, min_seeds).select("pattern", F.col("kind").alias("taught"), "score")
    more = tokens.select("k", "start", "end", "value", F.explode_outer("patterns").alias("pattern")).join(trusted, "pattern")
    more = more.groupBy("k", "start", "end", "value").agg(F.max(F.struct("score", "taught")).alias("b"))
    more = more.select("k", F.col("b.taught").alias("kind"), "start", "end", "value", F.lit(False).alias("base"))
    return base.select("k", "kind", "start", "end", "value", F.lit(True).alias("base")).unionByName(more)


def spans_by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, k and the sorted array spans (start, rank of kind, kind, end, base) of every document."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by = spans.groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("spans")
    )
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>")
    out = docs.select("doc_id", row_key().alias("k")).join(by, "k", "left")
    return out.withColumn("spans", F.coalesce("spans", nothing))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns stay.

    Overlapping spans become one, named by the first. Null text stays null; very long texts are scanned whole; equal
    rows get equal texts; columns of docs keep their values whatever their names; an empty table gives no rows.
    """
    key, found = fresh(docs, "k", "found")
    spans = personal_data(docs, **options)
    by = spans_by_document(docs, spans).filter(F.size("spans") > 0).select(F.col("k").alias(key), F.col("spans").alias(found)).dropDuplicates([key])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        gap = F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        return F.struct(
            F.when(new, F.concat(a["out"], gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], x["end"]).alias("at"),
        )

    new = F.aggregate(F.col(found), start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    out = docs.withColumn(key, row_key()).join(by, key, "left")
    return out.withColumn("text", F.when(F.col(found).isNull(), text).otherwise(new)).select(docs.columns)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    out = spans_by_document(docs, personal_data(docs))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return out.select(
        "doc_id",
        *[count(x).alias(f"n_{x}") for x in PATTERNS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )

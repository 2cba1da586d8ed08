"""Host-level quality rules with an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import covered, hashes, window_hashes, words
from marlstone.operators.skew import join_spread
from marlstone.storage import stored

#: Rule -> the condition on features under which a document fails it.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
#: A host falls if, at LEVEL standard deviations below its posterior mean, it still fails a rule EXCESS times as often
#: as the prior's mean, or more often than MAX_RATE.
LEVEL, EXCESS, MAX_RATE = 3.0, 1.5, 0.5


def features(docs: DataFrame) -> DataFrame:
    """Counts of words, symbols, repeated lines and repeated five-word windows of every text; null has none."""
    df = docs.select("doc_id", F.regexp_replace(F.lower("source"), r"^www\.", "").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    df = df.withColumn("w", words(text)).withColumn(
        "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes(F.col("w")).alias("h"),
    )
    df = df.withColumn("win", window_hashes(F.col("h"), 5))
    # Only texts with a repeated window need their windows sorted.
    df = df.withColumn(
        "s",
        F.when(
            F.size("win") > F.size(F.array_distinct("win")),
            F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("s")
    repeated = F.filter(
        s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
    )
    df = df.withColumn(
        "p", F.sort_array(F.transform(repeated, lambda x: F.struct(x["i"].alias("pos"), F.lit(5).alias("len"))))
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered(F.col("p")), F.lit(0).cast("long"))).drop("h", "win", "s", "p")


def host_rates(feats: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """host, rule, n, failed, rate, and the rate shrunk to the prior that all hosts' rates imply.

    The beta prior of a rule comes from the mean and variance of the hosts' rates, less the variance that
    counting alone would give. Hosts with few documents move to the mean, large ones keep their rate.
    """
    stack = ", ".join(f"'{name}', cast(coalesce({rule}, false) as int)" for name, rule in rules.items())
    long = feats.filter("host is not null").select("host", F.expr(f"stack({len(rules)}, {stack}) as (rule, fails)"))
    rates = long.groupBy("host", "rule").agg(F.count("*").alias("n"), F.sum("fails").alias("failed"))
    rates = rates.withColumn("rate", F.col("failed") / F.col("n"))
    prior = rates.groupBy("rule").agg(
        F.avg("rate").alias("m"), F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("inv_n")
    )
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv_n"), F.lit(1e-9))
    prior = prior.select("rule", "m", F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)).alias("strength"))
    # One row for each rule.
    a, total = F.col("failed") + F.col("m") * F.col("strength"), F.col("n") + F.col("strength")
    shrunk = a / total
    deviation = F.sqrt(shrunk * (1 - shrunk) / (total + 1))
    return rates.join(F.broadcast(prior), "rule").withColumns({"shrunk": shrunk, "deviation": deviation})


def host_verdicts(rates: DataFrame, max_rate: float = MAX_RATE, excess: float = EXCESS, level: float = LEVEL) -> DataFrame:
    """host, host_rate (its worst shrunk rate) and host_failed.

    A host fails by the beta posterior of its rate under some rule: if its mean exceeds max_rate, or if what it is at
    least (level deviations below the mean) exceeds the prior's mean excess times.
    """
    falls = (F.col("shrunk") > max_rate) | (F.col("shrunk") - level * F.col("deviation") > excess * F.col("m"))
    return rates.groupBy("host").agg(F.max("shrunk").alias("host_rate"), F.max(falls).alias("host_failed"))


def host_quality(docs: DataFrame, **limits) -> DataFrame:
    """Features of every document, its own base verdict, its host's worst shrunk rate and verdict, and kept.

    A host is a source; letter case and a leading "www." don't count. A host that fails loses all its documents. A
    null host has no verdict: its documents are judged alone. Null text has no words; texts count whole; equal rows get
    equal results; other columns, whatever their names, play no part; an empty table gives no rows.
    """
    feats = stored(features(docs), "quality-features")
    hosts = stored(host_verdicts(host_rates(feats), **limits), "quality-hosts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = join_spread(feats, hosts, "host", F.struct("doc_id", "n_words", "word_chars"), "left")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce("host_failed", F.lit(False)))


def op6_host_quality(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    out = host_quality(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

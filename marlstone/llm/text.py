"""Words and hashes of texts by built-in functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of ASCII white space, and of all that is no word character of the benchmark scan.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() is the same and faster where every character is ASCII."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, between: str = SPACE) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def hashes(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def window_hash(h: Column, i: Column, n: int) -> Column:
    """One hash of the n item hashes from position i (from 0)."""
    return F.xxhash64(*[F.get(h, i + j) if j else F.get(h, i) for j in range(n)])


def window_hashes(h: Column, n: int) -> Column:
    """A hash for each run of n items; none where there are fewer."""
    last = F.size(h) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: window_hash(h, i, n))).otherwise(
        F.array().cast("array<bigint>")
    )


def covered(spans: Column) -> Column:
    """How many positions the sorted structs (pos, len) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(x["pos"], a["end"]))).cast("long").alias("n"),
            F.greatest(a["end"], x["pos"] + x["len"]).cast("long").alias("end"),
        ),
        lambda a: a["n"],
    )


def row_key(text: str = "text") -> Column:
    """Names a row by 128 bits of a hash of its id and text; equal rows share it."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of df, case ignored."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.text import fresh
from marlstone.llm.tokens import U64, mix, tokens
from marlstone.storage import stored

#: Length of character n-grams, and the bound of the labelled sample: documents for each language, characters of one.
ORDER, SAMPLE_DOCS, SAMPLE_CHARS = 4, 400, 50_000
#: A fifth of the sample calibrates the rejection: the mean entropy plus so many deviations, more for short texts.
DEVIATIONS = 6.0
ROWS = 250
ADDED = ("lang_pred", "score", "entropy", "rejected")
#: A letter, by Unicode's categories L: not a digit, fraction or circled number.
LETTER = regex.compile(r"\p{L}")
KEYS = [U64(0x9E3779B97F4A7C15 + 2 * i) for i in range(ORDER + 1)]


def distinct_words(texts: list[str]):
    """(distinct lower-case words, the place of every word of the texts among them, where each text's begin)."""
    data = [t.lower().encode() for t in texts]
    joined = b"\n".join(data) + b"\n"
    hashes, bounds, starts, ends = tokens(data, spans=True)
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    words = [joined[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return words, place, bounds


class Grams:
    """Hashes of the n-grams that end at each character of the words, a space before and after each word.

    Contexts don't reach beyond the word, so a word's probability is its own and is worked out once.
    """

    def __init__(self, words: list[str]):
        chars = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(U64)
        space = chars == 32
        opening = np.maximum.accumulate(np.where(space, np.arange(len(chars)), 0))
        opening[1:] = opening[:-1].copy()  # of a closing space: the one before
        self.at = np.arange(1, len(chars))
        self.most = np.minimum(self.at - opening[1:] + 1, ORDER)
        self.word = np.cumsum(space)[:-1] - 1
        h = [np.full(len(chars), 7, U64)]
        for m in range(1, ORDER + 1):
            g = np.zeros(len(chars), U64)
            g[m - 1 :] = mix(h[-1][m - 1 :] + (chars[: len(chars) - m + 1] + U64(1)) * KEYS[m])
            h.append(g)
        self.h, self.chars = h, chars


def fit(words: list[str], counts: np.ndarray, uniform: float) -> list[dict[str, np.ndarray]]:
    """For each order the sorted hashes of n-grams with log probabilities, and of contexts with log weights.

    The longest n-grams and those from a word's start have their counts, the others the number of different
    characters before them, as Kneser and Ney have it.
    """
    g = Grams(words)
    weight = counts[g.word].astype(float)
    tables, shorter = [], {}
    number: dict[int, tuple] = {}
    for m in range(ORDER, 0, -1):
        ends = g.at[g.most >= m]
        keys, first = np.unique(g.h[m][ends], return_index=True)
        n = np.zeros(len(keys))
        whole = g.at[g.most == m] if m < ORDER else ends
        w = weight[whole - 1]
        n += np.bincount(np.searchsorted(keys, g.h[m][whole]), w, len(keys))
        if m < ORDER:
            rep = number[m + 1][1]  # one place for each longer n-gram
            n += np.bincount(np.searchsorted(keys, g.h[m][rep]), minlength=len(keys))
        number[m] = (keys, ends[first], n)
    for m in range(1, ORDER + 1):
        keys, rep, n = number[m]
        n1, n2 = float((n == 1).sum()), float((n == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, place = np.unique(g.h[m - 1][rep - 1], return_inverse=True)
        total, kinds = np.bincount(place, n), np.bincount(place)
        lam = d * kinds / total
        below = np.full(len(keys), uniform) if m == 1 else shorter["p"][np.searchsorted(shorter["k"], g.h[m - 1][rep])]
        p = np.maximum(n - d, 0) / total[place] + lam[place] * below
        shorter = {"k": keys, "p": p}
        tables.append({"keys": keys, "p": np.log(p), "contexts": context, "lam": np.log(lam)})
    return tables


class Models:
    """All languages' tables merged by hash: one search finds an n-gram's probability in each language."""

    def __init__(self, langs: list[str], tables: list[list[dict]], uniform: float):
        self.langs, self.uniform, self.orders = langs, float(np.log(uniform)), []

        def merge(k: str, v: str, m: int, missing: float):
            keys = np.unique(np.concatenate([t[m][k] for t in tables]))
            values = np.full((len(langs), len(keys)), missing)
            for i, t in enumerate(tables):
                values[i, np.searchsorted(keys, t[m][k])] = t[m][v]
            return keys, values

        for m in range(ORDER):
            self.orders.append((*merge("keys", "p", m, np.nan), *merge("contexts", "lam", m, 0.0)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its number of characters with the end."""
        if not words:
            return np.zeros((len(self.langs), 0)), np.zeros(0)
        g = Grams(words)
        logp = np.full((len(self.langs), len(g.at)), self.uniform)

        def find(table: np.ndarray, keys: np.ndarray):
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            return at, table[at] == keys

        for m, (keys, p, contexts, lam) in enumerate(self.orders, 1):
            use = np.flatnonzero(g.most >= m)
            ends = g.at[use]
            at, hit = find(keys, g.h[m][ends])
            back, known = find(contexts, g.h[m - 1][ends - 1])
            for i in range(len(self.langs)):
                own = np.where(hit, p[i, at], np.nan)
                logp[i, use] = np.where(np.isnan(own), logp[i, use] + np.where(known, lam[i, back], 0.0), own)
        sums = np.array([np.bincount(g.word, row, len(words)) for row in logp])
        return sums, np.bincount(g.word, minlength=len(words)).astype(float)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character of each text in each language; the characters."""
        words, place, bounds = distinct_words(texts)
        logp, size = self.words(words)
        def total(values):
            sums = np.concatenate([[0.0], np.cumsum(values[place])])
            return sums[bounds[1:]] - sums[bounds[:-1]]
        n = np.maximum(total(size), 1.0)
        return np.array([-total(x) / n for x in logp]), n


def labelled_sample(docs: DataFrame, train, docs_each: int, chars: int) -> DataFrame:
    """lang, text and turn of docs_each documents of each language at most, the least by a hash of the id.

    A first cut by the hash, at twice the share needed, keeps the window small whatever the table's size.
    """
    named = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= chars))
    named = named.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    share = named.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), F.lit(2.0 * docs_each) / F.col("n")).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}  # a number for each language
    cut = F.lit(False)
    for lang, x in shares.items():
        below = F.lit(min(int(x * (1 << 64)) - (1 << 63), (1 << 63) - 1))
        cut = cut | ((F.col("lang") == lang) & (F.col("h") <= below))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return named.filter(cut).withColumn("turn", turn).filter(F.col("turn") <= docs_each).drop("h")


def fit_languages(docs: DataFrame, train, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[Models, dict] | None:
    """The models and, for each language, mean and deviation of the entropy of texts that were not learned."""
    sample = stored(labelled_sample(docs, train, docs_each, chars), "language-sample")
    alphabet = 1024.0

    def one(key, table):
        words, place, _ = distinct_words([x for x in table["text"].to_pylist() if x])
        if not words:
            return pa.table({"lang": pa.array([], pa.string()), "m": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in ("keys", "p", "contexts", "lam")}})
        tables = fit(words, np.bincount(place, minlength=len(words)), 1 / alphabet)
        cols = {k: [t[k].tobytes() for t in tables] for k in ("keys", "p", "contexts", "lam")}
        return pa.table({"lang": [key[0].as_py()] * ORDER, "m": pa.array(range(ORDER), pa.int32()), **cols})

    schema = "lang string, m int, keys binary, p binary, contexts binary, lam binary"
    rows = sample.filter("turn % 5 != 0").groupBy("lang").applyInArrow(one, schema).collect()  # bounded by the sample
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    kinds = {"keys": U64, "p": float, "contexts": U64, "lam": float}
    by = {(r["lang"], r["m"]): {k: np.frombuffer(r[k], t) for k, t in kinds.items()} for r in rows}
    models = Models(langs, [[by[x, m] for m in range(ORDER)] for x in langs], 1 / alphabet)
    held = sample.filter("turn % 5 = 0").select("lang", "text").collect()  # bounded likewise
    limits = {}
    for i, lang in enumerate(langs):
        own = [r["text"] for r in held if r["lang"] == lang and LETTER.search(r["text"])]
        if own:
            h, n = models.texts(own)
            mean = float(np.median(h[i]))
            spread = float(np.median(np.abs(h[i] - mean) * np.sqrt(n))) * 1.4826
            limits[lang] = (mean, max(spread, 1.0), max(float(np.median(np.abs(h[i] - mean))) * 1.4826, 0.05))
        else:
            limits[lang] = (0.0, 1.0, float("inf"))
    return models, limits


def identify(docs: DataFrame, train, **sample) -> DataFrame:
    """All columns of docs as they are, with lang_pred, score, entropy (nats a character) and rejected.

    Where docs has a column of such a name, the new one has an underscore more (see fresh). Whole texts count,
    however long; equal rows get equal results.

    Learns from text and non-null lang where train holds; predicts from the text alone. The language is the
    one with the least cross-entropy a character; score is its share among the languages, at the weight of
    up to 40 characters. Rejected: und, and texts whose entropy is DEVIATIONS deviations above that of texts
    of the language, a deviation being larger the shorter the text. Null text, and text without a letter, is
    und with score 0; so is everything when nothing was labelled. Ties go to the first name.
    """
    fitted = fit_languages(docs, train, **sample)
    spark, added = docs.sparkSession, fresh(docs, *ADDED)
    shared = spark.sparkContext.broadcast(fitted)  # bounded by the sample

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                n = len(texts)
                lang, score, entropy, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
                some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if shared.value and some:
                    models, limits = shared.value
                    h, size = models.texts([texts[i] for i in some])
                    best = h.argmin(axis=0)
                    least = h[best, np.arange(len(some))]
                    score[some] = 1 / np.exp(-(h - least) * np.minimum(size, 40)).sum(axis=0)
                    entropy[some] = least
                    for j, i in enumerate(some):
                        lang[i] = models.langs[best[j]]
                        mean, spread, wide = limits[lang[i]]
                        rejected[i] = least[j] > mean + DEVIATIONS * (wide + spread / np.sqrt(size[j]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    names=[*part.schema.names, *added],
                )

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    columns += [f"`{name}` {kind}" for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True)]
    return docs.mapInArrow(run, ", ".join(columns))


def recognised(docs: DataFrame, train) -> DataFrame:
    """The documents that aren't rejected, with their own columns only."""
    rejected = fresh(docs, *ADDED)[-1]
    return identify(docs, train).filter(~F.col(rejected)).select(docs.columns)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    out = identify(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")

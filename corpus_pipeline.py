"""From documents to packed sequences: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.decontam import decontaminated
from marlstone.llm.jaccard import one_of_each
from marlstone.llm.langid import recognised
from marlstone.llm.packing import packed
from marlstone.llm.pii import redacted
from marlstone.llm.token_files import tokenizer_path
from marlstone.sources.tables import table
from marlstone.storage import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language accepts."""
    return recognised(docs, F.lit(True))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: four fifths of the five-word shingles are common."""
    return one_of_each(docs, percent=80, n=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into sequences of 4,096."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", sequences),
]

#: Language models and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

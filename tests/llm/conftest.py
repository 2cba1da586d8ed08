import pytest

ODD_ROWS = [
    (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "s", 3), (4, "one", "en", "s", 3), (5, "one two", "de", None, 7), (6, "one two", "de", None, 7),
    (None, "no id here at all", "en", "s", 1), (7, "twice the same row", "en", "s", 1), (7, "twice the same row", "en", "s", 1), (8, "word " * 30000, "en", "s", 150000),
    (9, "Ünïcode ÀÉ 日本語 \U0001f600 mixed space", "fr", "s", 9), (10, "9" * 20000 + " " + "a" * 20000 + "@" + "b." * 3000, "en", "s", 9), (11, "* # $ | <x> 1.2.3.4 +1 (234) 555-0100", "en", "t", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("k", "w", "h", "Score", "length", "spans", "_k", "_s", "entropy", "REJECTED", "lang_pred", "found", "node", "root", "g", "host", "kept", "n_words", "_part")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

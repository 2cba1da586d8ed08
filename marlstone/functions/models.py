"""Calls of language models as batches behind an interface, with rules for what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of a topic that was read from the body, and from the address alone.
BODY_BAND, URL_BAND = (0.8, 0.95), (0.5, 0.7)


def offline_model(texts: list[str]) -> list[str]:
    """Stands in for a model where none can be reached: the text's first words, so tests repeat."""
    return [" ".join((t or "").split()[:8]) for t in texts]


def with_answers(rows: DataFrame, prompt: str, answer: str, model: Callable[[list[str]], list[str]] = offline_model, most: int = 64) -> DataFrame:
    """Adds the model's answer to each prompt; a task asks for most prompts at a time. Null prompts are empty."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            out = [a for i in range(0, len(texts), most) for a in model(texts[i : i + most])]
            yield pd.Series(out, dtype="object")

    return rows.withColumn(answer, ask(F.col(prompt)))


def clamped(confidence: Column, has_body: Column) -> Column:
    """A model's confidence within the band of what it has seen."""
    band = lambda i: F.when(has_body, BODY_BAND[i]).otherwise(URL_BAND[i])
    return F.least(F.greatest(confidence, band(0)), band(1))


def fetch_state(body: Column) -> Column:
    """(ai_failed, needs_browser) of a page: both where no body could be read."""
    failed = body.isNull() | (F.trim(body) == "")
    return F.struct(failed.alias("ai_failed"), failed.alias("needs_browser"))

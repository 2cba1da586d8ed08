"""Queries with the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, date: str | None = None):
    """Registers (spark, folder) -> DataFrame under its name; a date column is given as text on both sides."""

    def add(f):
        @wraps(f)
        def run(spark, folder):
            out = f(spark, folder)
            return out.withColumn(date, out[date].cast("string")) if date else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"select * replace (cast({date} as varchar) as {date}) from ({sql})" if date else sql
        return f

    return add

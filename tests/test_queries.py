"""Every query of the engine's own operators against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from marlstone.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def value(x):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (float, Decimal)) else str(x) if x is not None else None

    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, FOLDER)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    found = plain([r[c] for c in columns] for r in ours.collect())
    expected = plain(theirs.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert found == expected

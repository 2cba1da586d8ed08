"""Hard negatives and packed scores against plain integer products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"
LEAST, MOST = -(2**63), 2**63 - 1


def plain(rows, anchor, k=5):
    good = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in good:
        if i is None or not anchor(i):
            continue
        scored = sorted((-max(LEAST, min(MOST, sum(a * b for a, b in zip(v, w, strict=False)))), (j is None, j or 0), m) for j, m, w in good if j != i)
        for p, (_, pid), _ in [x for x in scored if x[2] == l][:k]:
            fit = [(n, nid) for n, (_, nid), m in scored if m != l and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(fit)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(0 if x is None else x for x in r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()), key=str)


@pytest.mark.parametrize("values", [1 << 22, 1200])
def test_against_plain(spark, monkeypatch, values):
    """In one cell and in many; close vectors, ties, a hot label and copies of one vector."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.15, (12, 24))
    rows = [(i, int(i % 3 and rng.integers(0, 4)), [float(x) for x in np.float32(base[i % 12] + rng.normal(0, 0.02, 24))]) for i in range(400)]
    rows += [(1000 + i, int(i % 2), rows[0][2]) for i in range(60)]
    monkeypatch.setattr(negatives, "BLOCK_VALUES", values)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (10, None, [1.0, 1.0]), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [nan, 1.0]), (50, 2, [inf, 1.0]), (60, 1, []), (70, 1, [1.0]),
        (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (2, 2, [0.9, 0.5]), (None, 2, [0.95, 0.5]), (None, 1, [0.5, 0.5]), (3, 2, [-1.0, -1.0]), (4, 1, [-1.0, 0.2, 0.3]), (80, 3, [0.0, 0.0]), (5, 3, [0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("a", "c", "row", "anchor", "score", "n")})
    assert found(df) == plain(rows, lambda i: i % 10 == 0)


def test_huge_components(spark):
    """Fields wider than 64 bits; scores beyond long count as the nearest."""
    big = [3e38, 1e30, 1e12, 1e9, 1.0]
    rows = [(i, i % 2, [b * s, 1.0]) for i, (b, s) in enumerate((b, s) for b in big for s in (1, -1, 0.5, 0.9))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0])], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 200, 1e6, 1e12])
def test_packed_scores_are_exact(scale):
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(0, scale, (5, 7))), np.floor(rng.normal(0, scale, (20_000 if scale < 1e6 else 50, 7)))
    for row, got in zip(a, negatives.scores(a, b), strict=True):
        want = [max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(row, c, strict=True)))) for c in b]
        assert got.tolist() == want


def test_first_takes_ties_by_place():
    score = np.array([5, 7, 7, 5, 7, LEAST], np.int64)
    assert negatives.first(score, np.arange(6), 2).tolist() == [1, 2] and negatives.first(score, np.arange(6), 6).tolist() == [1, 2, 4, 0, 3, 5]

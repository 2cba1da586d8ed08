"""The manifest against a plain Merkle tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm import merkle

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """(top, for each leaf its path of (left, digest or None))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            s = i ^ 1
            p.append((s < i, level[s] if s < len(level) else None))
        level, at = [H(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


def fold(a, path):
    for left, d in path:
        a = H(d or "", a) if left else H(a, d or "")
    return a


def plain(rows, tampered=lambda r: False):
    leaf = lambda i, t, l, s, n: H(*map(field, (i, s, l, n, t)))
    by = {}
    for r in rows:
        i, t, l, s, n = r
        changed = leaf(i, t, l, s, n + 1 if n is not None and tampered(r) else n)
        by.setdefault(l, []).append(((i is not None, i or 0, leaf(*r)), i, leaf(*r), changed))
    langs = sorted(by, key=lambda l: (l is not None, (l or "").encode()))
    trees = {l: tree([x[2] for x in sorted(by[l])]) for l in langs}
    root, above = tree([trees[l][0] for l in langs])
    out = []
    for l, up in zip(langs, above, strict=True):
        for (_, i, own, changed), path in zip(sorted(by[l]), trees[l][1], strict=True):
            path = path + up
            end = fold(changed, path)
            out.append((i, own, trees[l][0], root, H(*[d for _, d in path if d]), end, end == root))
    return sorted(out, key=str)


def hit(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def found(df):
    n = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in merkle.manifest(df, n).collect()), key=str)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]
    assert found(odd) == plain(rows, lambda r: hit(r[0]))


@pytest.mark.parametrize("n", [1, 3, 256, 257, 1300])
def test_sizes(spark, n):
    """A language of n rows beside small ones: one bucket, its limits, and more than one."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(n)] + [(-1, None, None, None, None), (-2, "x", "de", "s", None)] + [(10_000 + i, "y", "é", "s", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = found(df)
    assert out == plain(rows, lambda r: hit(r[0]))
    for r in out:
        n_chars = next(x[4] for x in rows if x[0] == r[0])
        assert r[-1] == (not hit(r[0]) or n_chars is None)


def test_many_languages(spark):
    rows = [(i, f"t{i}", f"l{i % 300}", "s", i) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(df) == plain(rows, lambda r: hit(r[0]))


def test_untampered_one_row_and_empty(spark, empty):
    df = spark.createDataFrame([(5, "t", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(df).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == H("")
    assert merkle.manifest(empty).count() == 0


def test_copies_of_one_row(spark):
    df = spark.range(600).selectExpr("7L as doc_id", "'same' as text", "'en' as lang", "'s' as source", "4L as n_chars")
    assert found(df) == plain([(7, "same", "en", "s", 4)] * 600, lambda r: hit(r[0]))

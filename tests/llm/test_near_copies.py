"""The pipeline's near copies, by five words and 0.8, against brute force."""

import os
import re

import numpy as np

import corpus_pipeline
from marlstone.llm import jaccard as join
from marlstone.storage import shared_dir

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(a, b, n):
    a, b = grams(a, n), grams(b, n)
    return len(a & b) / len(a | b) if a | b else 0


def plain_kept(rows, n=5, percent=80):
    sets, root = {i: grams(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and (100 + percent) * len(sets[i] & sets[j]) >= percent * (len(sets[i]) + len(sets[j])):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted({find(i) for i in sets})


def test_copies_between_the_thresholds(spark, docs):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    block = " ".join(base[:90] + [f"z{i}" for i in range(14)] + base[104:])
    longer = " ".join(base + [f"y{i}" for i in range(40)])
    for t in (block, longer):
        assert 0.8 <= jaccard(" ".join(base), t, 5) < 0.9 and jaccard(" ".join(base), t, 3) < 0.9
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10_000, " ".join(base)), (10_001, block), (10_002, longer)]
    for i in range(120):  # one text with some words changed, at the threshold
        w = [f"v{k}" for k in range(100)]
        for j in rng.integers(0, 100, rng.integers(1, 5)):
            w[j] = f"x{rng.integers(0, 9)}"
        rows.append((20_000 + i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema).repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, df, "").select("doc_id").collect())
    assert 10_000 in kept and not {10_001, 10_002} & set(kept) and kept == plain_kept(rows)


def test_a_passage_of_every_document(spark, docs):
    """Shingles that all documents have pass once for each batch, and decide some links."""
    head = " ".join(f"h{i}" for i in range(30))
    rows = [(i, f"{head} " + " ".join(f"t{i % 7}_{k}" for k in range(i % 11))) for i in range(300)] + [(300 + i, head) for i in range(50)]
    rows += [(400 + i, " ".join(["again"] * (i + 1))) for i in range(9)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema).repartition(3)
    kept = sorted(r.doc_id for r in join.one_of_each(df, percent=80, n=5).select("doc_id").collect())
    assert kept == plain_kept(rows) and 1 < len(kept) < 200


def test_numbers_of_shingles_over_batches():
    """The counts that batches get back, over all batches, are those of plain counting."""
    rng = np.random.default_rng(1)
    sent = []
    for g in range(3):
        shingle = np.sort(rng.integers(0, 40, 60).astype(np.uint64)) << np.uint64(16) | np.arange(60, dtype=np.uint64)
        first = np.concatenate([[True], (shingle[1:] >> np.uint64(16)) != (shingle[:-1] >> np.uint64(16))])
        number = np.diff(np.flatnonzero(first), append=60).astype(np.uint64)
        sent.append((0, g, 0, join.pack_sorted(shingle[first]), join.planes(number), None))
        sent.append((0, g, 3, join.pack_sorted(shingle[~first]), None, None))
    every = np.concatenate([join.unpack_sorted(r[3]) for r in sent]) >> np.uint64(16)
    plain = dict(zip(*np.unique(every, return_counts=True), strict=True))
    back = join._count((None,), join.packets(sent)).to_pylist()
    assert sum(r["kind"] == 3 for r in back) == 3
    for r in back:
        if r["kind"] == 0:
            keys, number = join.unpack_sorted(r["a"]) >> np.uint64(16), join.unplanes(r["b"], np.uint64)
            assert [plain[k] for k in keys] == number.tolist() and (number > 1).all()
    asked = {int(k) for r in back if r["kind"] == 0 for k in join.unpack_sorted(r["a"]) >> np.uint64(16)}
    assert asked == {int(k) for k, n in plain.items() if n > 1}


def test_only_the_rows_stay_in_the_shared_folder(spark, docs):
    path = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(path))
    join.rooted_rows(docs, 80, 5)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(path)) - before] == ["jaccard-rows"]

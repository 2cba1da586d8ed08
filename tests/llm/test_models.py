"""Models, token files, packing, the join and the pipeline against brute force and held-out texts."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import ODD_ROWS as ODD
from marlstone.llm import encode, jaccard, langid, packing, queries, token_files, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def test_word_hashes_are_those_of_words():
    texts = ["A b  a\n", "", "é É b", "x" * 3000 + " b"]
    h, at = tokens.tokens([t.encode() for t in texts], block=64)
    own = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(x) for x in own] == [3, 0, 3, 2] and own[0][0] == own[0][2] and own[0][1] == own[2][2] == own[3][1] and own[2][0] != own[2][1]


def test_language_of_held_out_texts(spark):
    rows = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = docs.merge(rows, on="doc_id")
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and both.rejected.mean() < 0.02 and both.score.between(0, 1).all()


def test_language_odd_rows(spark, docs, odd, empty):
    both = docs.select("doc_id", "text", "lang").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang"))
    got = {r.doc_id: r for r in langid.identify(both, F.col("doc_id") < 10**6).collect()}
    assert {got[10**6 + i].lang_pred for i in (1, 2, 3)} == {"und"} and got[10**6 + 1].rejected and got[10**6 + 8].lang_pred != "und"
    assert langid.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred_"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    ws, counts = ["ab", "abc", "b", "cab"], np.array([3, 1, 2, 1])
    chars = sorted({*"".join(ws), " "})
    model = langid.Models(["x"], [langid.fit(ws, counts, 1 / len(chars))], 1 / len(chars))

    def logs(word):  # of each character of a word and of its end, from the model's sums over words
        g = langid.Grams([word])
        out = np.full(len(g.at), model.uniform)
        for m, (keys, p, contexts, lam) in enumerate(model.orders, 1):
            for j, end in enumerate(g.at):
                if g.most[j] >= m:
                    at, back = np.searchsorted(keys, g.h[m][end]), np.searchsorted(contexts, g.h[m - 1][end - 1])
                    known = at < len(keys) and keys[at] == g.h[m][end]
                    seen = back < len(contexts) and contexts[back] == g.h[m - 1][end - 1]
                    out[j] = p[0, at] if known else out[j] + (lam[0, back] if seen else 0.0)
        assert math.isclose(out.sum(), model.words([word])[0][0, 0])
        return out

    for history in ("", "a", "b", "ab", "ca", "abc", "cc"):  # over all characters that can follow, and the end
        total = sum(math.exp(logs(history + c)[len(history)]) for c in chars if c != " ")
        total += math.exp(logs(history)[len(history)]) if history else 0  # no word is empty, though the model has a share for it
        assert 0.5 < total < 1 if not history else math.isclose(total, 1, rel_tol=1e-9), history


def test_letters_and_foreign_texts(spark, docs):
    more = [(10**6, "\u00b2 \u00bd \u2460 12"), (10**6 + 1, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059 " * 40), (10**6 + 2, "qzxj vkqw xxzq jjqk wvzx " * 60)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(both, F.col("doc_id") < 10**6).filter("doc_id >= 1000000").collect()}
    assert (got[10**6].lang_pred, got[10**6].score) == ("und", 0.0) and all(got[10**6 + i].rejected for i in range(3))


def test_stages_leave_clashing_columns(spark, odd):
    """Extra columns of any name keep their values in every stage but the last."""
    extra = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        assert all(r[c] == 1 for r in out.collect() for c in extra), name


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_as_whole_texts(name, spaced):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path(name)
    own, whole = encode.Encoder(path, spaced, most=50), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = ["", " ", "a  b", " a", "a \n b\n\n", "it's  don't\t\tx", "É à ñ  b    c", "a\x1c b", "<|endoftext|> x<|endoftext|>", "1234 5,6 !!  ?", "日本 語\U0001f600", "ΣΑΣ ς", "a" * 500, "\r\n \x0b\x0c z"]
    for t in texts * 2:
        assert own.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path("byte_bpe_50k.json"))
    path = str(tmp_path / "orc")
    token_files.write_token_files(docs, path, token_files.tokenizer_path("byte_bpe_50k.json"), file_bytes=100_000)
    got, start = {r.doc_id: r for r in token_files.token_offsets(spark, path).collect()}, 0
    for r in sorted(docs.collect()):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_files.read_token_files(spark, path).filter("doc_id = 5")
    assert one.count() == 1 and "EqualTo(doc_id,5)" in one._jdf.queryExecution().toString()
    for name, df, n in (("odd", odd, odd.count()), ("empty", empty, 0)):
        token_files.write_token_files(df, str(tmp_path / name), token_files.tokenizer_path("byte_bpe_50k.json"))
        rows = token_files.token_offsets(spark, str(tmp_path / name)).collect()
        assert len(rows) == n and sorted(r.start for r in rows) == [0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1].tolist()][: len(rows)]


def test_local_search_empties_bins():
    sizes = [6, 5, 5, 4, 4, 3, 3]
    bins = [[0], [1], [2], [3, 5], [4, 6]]
    out = packing.improve(bins, sizes, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(7)) and all(sum(sizes[i] for i in b) <= 10 for b in out)


def check_packed(rows, n_docs):
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for own in seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({(r.doc_id, r.piece) for r in rows}) <= len(rows) and sum(r.piece == 0 for r in rows) == n_docs
    return len(seq), -(-sum(r.length for r in rows) // 4096)


def test_packing(spark, docs, odd, empty, monkeypatch):
    path = token_files.tokenizer_path("word_bpe_49k.json")
    n, bound = check_packed(packing.packed(docs, path).collect(), docs.count())
    assert n <= bound + 1
    check_packed(packing.packed(odd, path).collect(), odd.count())
    assert packing.packed(empty, path).count() == 0
    pieces = packing.cut_pieces(docs, path)
    many = pieces.join(packing.plan(pieces, group=40), "pid").collect()
    n, bound = check_packed(many, docs.count())
    assert n <= 1.05 * bound + 1


def plain_components(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and (100 + percent) * len(a & b) >= percent * (len(a) + len(b)):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark, docs):
    rng = np.random.default_rng(7)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    for i in range(150):  # near copies of one text, at the threshold
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(1, 5)):
            w[j] = f"z{rng.integers(0, 9)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000 + i, " ".join(base[: 9 + i % 4])) for i in range(8)] + [(30_000, None), (30_001, " "), (30_002, "One"), (30_003, "one"), (30_004, "one two"), (30_005, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(df).collect()}
    assert got == plain_components(rows)


@pytest.mark.parametrize("block", [4, 16])
def test_blocks_of_a_cluster_agree(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(4):  # chains of edits: most members don't link with their cluster's pivot
        w = [f"w{x}" if family % 2 else f"v{x}" for x in range(90)]
        for i in range(40):
            rows.append((1000 * family + i, " ".join(w)))
            w = list(w)
            w[rng.integers(0, 90)] = f"z{rng.integers(0, 4)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    members, found = jaccard.similar_links(df, block=block)
    from marlstone.operators.components import connected_components

    labels = {bytes(r.node): bytes(r.component) for r in connected_components(found).collect()}
    own = plain_components(rows)
    sets = jaccard.shingle_sets([t for _, t in rows])
    label = {i: labels.get(jaccard.node_of(s), jaccard.node_of(s)) for (i, _), s in zip(rows, sets, strict=True)}
    for i, _ in rows:
        for j, _ in rows:
            assert (own[i][1] == own[j][1]) == (label[i] == label[j])


def test_jaccard_odd_rows(odd, empty):
    rows = jaccard.similar_components(odd).collect()
    own = {i: (n, c) for (i, _), (n, c) in zip(((i, t) for i, t, *_ in ODD), plain_components([(x, t) for x, (_, t, *_) in enumerate(ODD)]).values(), strict=True)}
    named = [(i, own[i][0], ODD[own[i][1]][0]) for i, *_ in ODD]
    assert sorted(map(str, named)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows)
    assert jaccard.similar_components(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id or 0 for x in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]


def test_pipeline_stages(spark, docs, benchmark):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, spark.createDataFrame(stage(spark, out, FOLDER).collect(), docs.schema)
        assert out.columns == docs.columns, name
        left = {r.doc_id: r.text for r in out.collect()}
        if name == "jaccard_join":
            assert sorted(left) == sorted({c for _, c in plain_components([(r.doc_id, r.text) for r in before.collect()], n=5, percent=80).values()})
        if name == "decontamination":
            grams = {tuple(w[i : i + 10]) for w in (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOW)) for r in benchmark.collect()) for i in range(max(1, len(w) - 9)) if w}
            hit = {r.doc_id for r in before.collect() if any(tuple(w[i : i + 10]) in grams for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOW))] for i in range(len(w)))}
            assert sorted(left) == sorted({r.doc_id for r in before.collect()} - hit)
        if name == "personal_data":
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t in left.values()) and len(left) == before.count()
    assert out.count() > 0.5 * docs.count()


def test_pipeline_runs(spark):
    n, bound = check_packed(rows := corpus_pipeline.run(spark, FOLDER).collect(), sum(r.piece == 0 for r in corpus_pipeline.run(spark, FOLDER).collect()))
    assert n <= bound + 1 and rows


def test_pieces_of_the_query(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[r.doc_id, i] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    rows = queries.QUERIES["op7_pack"](spark, FOLDER).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)

"""The Katz model of several orders against brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import katz, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Plain:
    """The recursion by dictionaries: counts of tuples, where a document begins with <s>."""

    def __init__(self, train, order):
        self.order = order
        self.count = {m: Counter(tuple(t[i - m + 1 : i + 1]) for t in train for i in range(max(m - 1, 1), len(t))) for m in range(1, order + 1)}
        self.size = {m: Counter(g[:-1] for g in self.count[m + 1].elements()) for m in range(1, order)}
        self.n = sum(self.count[1].values())
        self.d = {m: katz.discounts([0, *[sum(x == r for x in c.values()) for r in range(1, katz.TOP + 2)]]) for m, c in self.count.items()}
        self.after = defaultdict(list)
        for m in range(2, order + 1):
            for g in self.count[m]:
                self.after[g[:-1]].append(g)
        self.one = {g[0]: self.left(1, x) / self.n for g, x in self.count[1].items()}
        self.unknown = 1 - sum(self.one.values())
        self.weights = {}

    def left(self, m, x):
        return x * (self.d[m][x] if x <= katz.TOP else 1)

    def weight(self, h):
        """(scale, backoff weight) of a context."""
        if h not in self.weights:
            m, n = len(h) + 1, self.size[len(h)][h]
            num = sum(self.left(m, self.count[m][g]) / n for g in self.after[h])
            s = n / (n + 1) if num > 1 - 1e-9 else 1
            self.weights[h] = s, (1 - s * num) / (1 - sum(self.p(g[1:-1], g[-1]) for g in self.after[h]))
        return self.weights[h]

    def p(self, h, w):
        if not h:
            return self.one.get(w, self.unknown)
        m, n = len(h) + 1, self.size[len(h)].get(h, 0)
        if not n:
            return self.p(h[1:], w)
        s, a = self.weight(h)
        x = self.count[m].get((*h, w), 0)
        return s * self.left(m, x) / n if x else a * self.p(h[1:], w)

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), t[i])) for i in range(1, len(t)))


def lists(docs):
    return {r.doc_id: ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW)), None] for r in docs.collect()}


@pytest.mark.parametrize(("order", "sizes"), [(2, (1 << 30, 1 << 30, 9)), (3, (60_000, 40_000, 999)), (3, (30_000, 10_000, 3)), (4, (60_000, 40_000, 4))])
def test_scores_and_sums(spark, docs, order, sizes):
    """The last two send by relays."""
    toks = lists(docs)
    held = {i for i in toks if i % 5 == 0}
    own = Plain([t for i, t in toks.items() if i not in held], order)
    got = {r.doc_id: r for r in katz.katz_scores(docs, F.col("doc_id") % 5 == 0, order, *sizes).collect()}
    assert len(got) == len(toks)
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t) - 1, sum((w,) in own.count[1] for w in t[1:]), own.n, i in held)
        assert math.isclose(r.score, own.score(t), rel_tol=1e-9), i
        assert math.isclose(r.base_score, sum(math.log10((own.count[1][w,] + 1) / (own.n + len(own.count[1]) + 1)) for w in t[1:]), rel_tol=1e-9)
    for h in [("<s>",), ("the",), ("never-seen",), *list(own.after)[:: len(own.after) // 40]]:
        if len(h) < order:
            assert math.isclose(sum(own.p(h, w) for (w,) in own.count[1]) + own.p(h, "never-seen"), 1, rel_tol=1e-9)
    assert sum(got[i].score - got[i].base_score for i in held) > 0


def test_higher_order_is_no_worse_on_held_out_texts(spark, docs):
    held = F.col("doc_id") % 5 == 0
    two, three = (katz.katz_scores(docs, held, m).filter("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0] for m in (2, 3))
    assert three > two - 0.05


def test_odd_rows(odd, empty):
    rows = katz.katz_scores(odd, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert katz.katz_scores(empty, F.lit(False)).count() == 0
    assert {r.score for r in katz.katz_scores(odd, F.lit(True)).collect()} == {0.0}


def test_query(spark, docs):
    toks = lists(docs)
    rows = queries.QUERIES["op1_katz_scores"](spark, "/root/testdata/sf0.001").collect()
    own = Plain([toks[r.doc_id] for r in rows if not r.held_out], katz.ORDER)
    assert len(rows) == len(toks) and all(math.isclose(r.score, own.score(toks[r.doc_id]), rel_tol=1e-9) for r in rows)


@pytest.mark.parametrize(("order", "passes"), [(1, 2), (2, 2), (3, 3)])
def test_scores_need_no_further_pass_over_the_texts(spark, docs, monkeypatch, order, passes):
    """The last sums come back with what the documents have without them."""
    plans, kept = [], katz.stored

    def stored(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, *args)

    monkeypatch.setattr(katz, "stored", stored)
    assert katz.katz_scores(docs, F.col("doc_id") % 5 == 0, order).count() == docs.count()
    assert sum("katz_texts" in p for p in plans) == passes

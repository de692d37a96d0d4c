import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagework.llm import katz_lm as K


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


class Brute:
    """The model straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.count = order, [collections.Counter() for _ in range(order)]
        for t in texts:
            w = tokens(t)
            padded = ["<begin>"] * (order - 1) + w
            for i in range(len(w)):
                for k in range(order):
                    self.count[k][tuple(padded[i + order - 1 - k : i + order])] += 1
        self.n = sum(self.count[0].values())
        self.d = [K.discounts(np.array([sum(c == r for c in x.values()) for r in range(1, K.DISCOUNTED + 2)])) for x in self.count]
        self.after = [collections.defaultdict(dict) for _ in range(order)]
        for k, x in enumerate(self.count):
            for g, c in x.items():
                self.after[k][g[:-1]][g[-1]] = c

    def less(self, c, k):
        return (self.d[k][c] if c <= K.DISCOUNTED else 1.0) * c

    def p(self, h, w):
        after = self.after[len(h)].get(h)
        if not h:
            used = sum(self.less(c, 0) for c in (after or {}).values())
            below = self.n if used < self.n else self.n + 1
            return self.less(after[w], 0) / below if after and w in after else 1 - used / below
        if not after:
            return self.p(h[1:], w)
        used, seen = sum(self.less(c, len(h)) for c in after.values()), sum(after.values())
        below = seen if used < seen * (1 - 1e-12) else seen + 1
        if w in after:
            return self.less(after[w], len(h)) / below
        return (1 - used / below) / (1 - sum(self.p(h[1:], x) for x in after)) * self.p(h[1:], w)

    def score(self, t):
        w = tokens(t)
        padded = ["<begin>"] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), x)) for i, x in enumerate(w))


@pytest.fixture
def small(monkeypatch):
    """Settings that the workers, too, see."""

    def put(**values):
        for k, v in values.items():
            monkeypatch.setattr(K, k, v)
        cloudpickle.register_pickle_by_value(K)

    yield put
    cloudpickle.unregister_pickle_by_value(K)


@pytest.mark.parametrize("split,chunk,order", [(500_000, 8_000_000, 3), (15, 400, 3), (15, 400, 2), (4, 100, 4), (15, 400, 1)])
def test_against_brute_force(spark, small, split, chunk, order):
    small(SPLIT=split, CHUNK=chunk, WORDS=20, PAIRS=60)
    rng = random.Random(split)
    texts = [" ".join(rng.choices(["the", "Cat", "dog", "of", "été", *(f"w{i}" for i in range(25))], weights=[20, 10, 8, 8, 5, *[1] * 25], k=rng.randint(0, 25))) for _ in range(70)]
    long = " ".join(rng.choices(["the", "cat", "dog", "w1", "w2"], k=600))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(70, None, "y"), (None, "the cat", "z"), (3, texts[3], "w"), (71, "never seen words", "q"), (72, long, "long"), (73, "the of the of the of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Brute([t for i, t, _ in rows if not held(i)], order)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in K.katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=order).collect())
    want, known = [], model.count[0]
    for i, t, _ in rows:
        w = tokens(t)
        base = sum(math.log10((known[(x,)] + 1) / (model.n + len(known) + 1)) for x in w)
        want.append((i if i is not None else -1, held(i), len(w), sum((x,) in known for x in w), model.n, round(base, 6), round(model.score(t), 6)))
    assert got == sorted(want)
    for h in [("<begin>",) * (order - 1), ("the",) * (order - 1), ("cat", "the", "the")[: order - 1], ("nothing", "w3", "of")[: order - 1]]:
        assert abs(sum(model.p(h, w) for w in [*(x for x, in known), "unknown word"]) - 1) < 1e-9


def test_history_whose_followers_are_in_another_batch(spark, small):
    small(CHUNK=40)
    texts = ["the cat sat the cat ran", "the cat the dog the cat", "the dog sat the dog ran", "the unheard", "cat unheard the unseen", "sat the cat unheard the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in K.katz_scores(docs, F.col("doc_id") >= 3).collect()}
    model = Brute(texts[:3], K.ORDER)
    for i, t in enumerate(texts):
        assert abs(got[i] - model.score(t)) < 1e-9


def test_every_gram_seen_is_stored(spark):
    texts = ["rare pair once", "the other pair twice", "the other pair here", "rare pair once", "new pair once", "other rare words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in K.katz_scores(docs, F.col("doc_id") >= 3).collect()}
    model = Brute(texts[:3], K.ORDER)
    assert model.count[1][("rare", "pair")] == model.count[2][("rare", "pair", "once")] == 1
    for i, t in enumerate(texts):
        assert abs(got[i] - model.score(t)) < 1e-9


def test_nothing_is_left_but_the_scores(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b a")], "doc_id long, text string")
    before = {x.name for x in spark.catalog.listTables()}
    found = K.katz_scores(docs, F.lit(False))
    assert {x.name for x in spark.catalog.listTables()} == before and found.count() == 2


def test_empty_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert K.katz_scores(docs.limit(0), F.lit(False)).count() == 0
    got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in K.katz_scores(docs, F.lit(True)).collect()}
    assert got == {1: (3, 0, 0.0), 2: (1, 0, 0.0)}


@pytest.mark.parametrize("top", [5, 1 << 20, (1 << 64) - 1])
def test_one_sort_gives_what_numpy_gives(top):
    rng = np.random.default_rng(top % 97)
    drawn = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
    close = np.uint64(7 << 60) + rng.integers(0, 50, 3000, dtype=np.uint64)  # differ in low bits only
    for high in (drawn, np.concatenate((drawn, drawn[:900])), close, drawn[:1], drawn[:0]):
        found, order = K._sorted(high)
        assert order.tolist() == np.argsort(high, kind="stable").tolist() and found.tolist() == high[order].tolist()
        kinds, at = K._unique(high)
        want = np.unique(high, return_inverse=True)
        assert kinds.tolist() == want[0].tolist() and at.tolist() == want[1].tolist()
        for low in (rng.integers(0, 9, len(high), dtype=np.uint64), high[::-1].copy()):
            order, begin, one, two = K._pairs(high, low)
            assert order.tolist() == np.lexsort((low, high)).tolist()
            assert list(zip(one.tolist(), two.tolist())) == sorted(set(zip(high.tolist(), low.tolist()))) and len(begin) == len(one)
            assert high[order[begin]].tolist() == one.tolist() and low[order[begin]].tolist() == two.tolist()

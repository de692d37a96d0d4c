import collections
import random

import numpy as np

from passagework.llm import suffix_dedup as S


def brute(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t))) for i in range(len(t)) if gone[i] and not (i and gone[i - 1])]
        out.append((bytes(b for b, g in zip(t, gone) if not g), runs))
    return out


def corpus(rng, n):
    share = [bytes(rng.choices(b"abcd \n", k=rng.randint(20, 120))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(share), bytes(rng.choices(b"abcdefghij ", k=rng.randint(0, 90)))]) for _ in range(rng.randint(0, 5))]
        texts.append(b"".join(parts))
    return texts + [b"a" * 300, texts[0], texts[1] * 2, b"ab" * 100]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    for split, length in ((3, 40), (4000, 64), (2, 12)):
        monkeypatch.setattr(S, "SPLIT", split)
        monkeypatch.setattr(S, "SHARD", 3000)
        texts = corpus(rng, 60)
        rows = [(i, t.decode(), "x") for i, t in enumerate(texts)] + [(900, None, None), (None, "short", "y"), (5, texts[7].decode(), "z")]
        docs = spark.createDataFrame(rows, "doc_id int, text string, _text string").repartition(5)
        all_texts = [(r[1] or "").encode() for r in rows]
        want = sorted((str(r[0]), len(t), *k) for r, t, k in zip(rows, all_texts, brute(all_texts, length)))
        got = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), [(x.start, x.end) for x in r.spans]) for r in S.suffix_dedup(docs, length=length).collect())
        assert got == want


def test_one_very_long_text(spark):
    rng = random.Random(6)
    part = "".join(rng.choices("abcdefgh ", k=3_000))
    text = "".join(rng.choices("ijklmnop ", k=1_500_000)) + part + "".join(rng.choices("qrstuvw ", k=1_500_000)) + part
    docs = spark.createDataFrame([(1, text), (2, "x " + part[100:400])], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in S.suffix_dedup(docs).collect()}
    assert got == {1: [(1_500_000, 1_503_000), (3_003_000, 3_006_000)], 2: [(2, 302)]}


def test_unique_ids_and_empty(spark):
    base = "".join(random.Random(1).choices("xyz w", k=260))
    docs = spark.createDataFrame([(1, "left " + base), (2, base + " right"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in S.suffix_dedup(docs).collect()}
    assert got == {1: (b"left ", 1), 2: (b" right", 1), 3: (b"", 0)}
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(2)
    strings = [bytes(rng.choices(b"\0ab", k=rng.randint(0, 40))) for _ in range(30)]
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(symbols))
    order = S.suffix_array(symbols, left)
    suffix = [tuple(symbols[i : i + left[i]]) for i in range(len(symbols))]
    assert list(order) == sorted(range(len(symbols)), key=lambda i: (suffix[i] + (0,), i))
    prefix = S.common_prefixes(symbols, left, order)
    for k in range(1, len(order)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert prefix[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

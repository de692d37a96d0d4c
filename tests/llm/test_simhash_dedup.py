import random
import re

import numpy as np
import xxhash

from passagework.llm import simhash_dedup as S
from passagework.llm.components import components


def brute_fingerprint(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, ids, radius):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [min((ids[j] for j in range(len(ids)) if root[j] == root[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices(["alpha", "Beta", "gamma", "delta", "été", "x"], k=rng.randint(1, 40))) for _ in range(40)]
    texts = base + [b + " tail" for b in base[:20]] + [b.replace(" ", "\n\t ", 1) for b in base[:10]] + [None, "", "  \n", "one", "ONE"] + [" ".join(rng.choices("abcdef", k=900))] * 3
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, fp int").repartition(4)
    values = [brute_fingerprint(r[1], 4) for r in rows]
    want = sorted(map(str, zip([r[0] for r in rows], values, brute_components(values, [r[0] for r in rows], 4))))
    got = sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.simhash_dedup(docs).collect())))
    assert got == want
    assert S.simhash_dedup(docs.limit(0)).count() == 0


def test_links_lose_none(spark, monkeypatch):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        values.append(rng.choice(values[:90]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    values = list(dict.fromkeys(values))
    want = brute_components(values, values, 4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint").repartition(6)
    for block, row_ns in ((4096, 1500), (16, 1), (7, 1e9)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "ROW_NS", row_ns)
        joined = {r.u: r.v for r in components(S.links(nodes, 4)).collect()}
        groups = {}
        for v, w in zip(values, want):
            groups.setdefault(w, set()).add(joined.get(signed(v), signed(v)))
        assert all(len(x) == 1 for x in groups.values())
        assert len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_plan_covers_the_radius():
    rng = np.random.default_rng(1)
    for total in (10, 10**5, 10**9, 10**12):
        for radius in (0, 1, 4, 7):
            chosen = S.plan(rng.integers(0, 1 << 63, 500).astype(np.uint64), total, radius)
            assert sum(t + 1 for _, t in chosen) >= radius + 1


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (200, 201), (300, 200)], "a long, b long")
    got = {r.u: r.v for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {201: 200, 300: 200}


def test_forest_of_similar_sets():
    rng = np.random.default_rng(4)
    for case in range(60):
        n = int(rng.integers(1, 40))
        sets = [np.unique(rng.choice(30, int(rng.integers(0, 6)))).astype(np.uint64) for _ in range(n)]
        root, side = rng.integers(0, n + 1, n), rng.integers(1, 3, n) if case % 2 else np.zeros(n, int)

        def components(pairs):
            label = list(range(n))
            for i, j in pairs:
                label = [label[i] if x == label[j] else x for x in label]
            return {frozenset(k for k in range(n) if label[k] == x) for x in label}

        given = [(i, j) for i in range(n) for j in range(i) if root[i] == root[j]]
        alike = [(i, j) for i in range(n) for j in range(i) if side[i] + side[j] in (0, 3) and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
        found = S.similar_forest(sets, root, side, 0.8)
        assert components(given + found) == components(given + alike) and len(found) < n
        assert all((i, j) in alike or (j, i) in alike for i, j in found)


def test_blocks_of_a_bucket_leave_no_pair_out(spark, monkeypatch):
    """Texts that no leader joins, in buckets dealt out as pairs of blocks."""
    monkeypatch.setattr(S, "TEXTS", 7)
    monkeypatch.setattr(S, "TURNS", 0)
    rng = random.Random(12)
    base = [f"word{i}" for i in range(200)]
    texts = []
    for i in range(70):
        w = list(base)
        for at in rng.sample(range(200), rng.choice([1, 4, 5, 6])):
            w[at] = f"edit{i}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    root = list(range(70))
    for i in range(70):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert {r.doc_id for r in S.near_duplicates(docs).collect()} == set(root)

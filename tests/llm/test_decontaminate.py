import collections
import random
import re

from passagework.llm.decontaminate import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(text, item):
    d, w = words(text), words(item)
    if not w:
        return 0.0
    k, n = min(5, len(w)), len(w)
    bag = lambda x: collections.Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    best, own = 0.0, bag(w)
    for s in range(max(1, len(d) - n + 1)):
        there = bag(d[s : s + n])
        if union := sum((own | there).values()):
            best = max(best, sum((own & there).values()) / union)
    return best


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "Of", "été", *(f"w{i}" for i in range(60))]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 4, 5, 6, 20, 40, 60]))) for _ in range(25)] + ["a a a a a a a a a a", None, "w1 w2"]
    texts = []
    for _ in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        if rng.random() < 0.7:
            w = words(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w)) if rng.random() < 0.5 else rng.choice([0, -1])] = "changed"
            parts += [" \n".join(w[rng.choice([0, 0, 1]) :]).upper(), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        texts.append(" ".join(parts))
    texts += [None, "", "a a a a a a a a a a", "a a a a a a a a a"]
    docs = spark.createDataFrame([(i if i % 11 else None, t, i) for i, t in enumerate(texts)], "doc_id int, text string, item int").repartition(3)
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = sorted(map(str, ((r.doc_id, [(m.item, round(m.similarity, 9)) for m in r.matches or ()]) for r in decontaminate(docs, table).collect())))
    want = []
    for i, t in enumerate(texts):
        want.append((i if i % 11 else None, [(k, round(s, 9)) for k, item in enumerate(items) if (s := brute(t, item)) >= 0.8]))
    assert got == sorted(map(str, want))
    assert sum(bool(m) for _, m in want) > 20
    assert decontaminate(docs.limit(0), table).count() == 0
    assert decontaminate(docs, table.limit(0)).where("contaminated").count() == 0

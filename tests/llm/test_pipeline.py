"""Stages against brute force, on documents made here with planted copies, passages and leaks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm.simhash_dedup import fingerprints, near_duplicates

STEMS = {"en": ["the", "and", "thing", "ever", "rest", "wh", "or", "ly"], "de": ["der", "und", "schen", "heit", "zu", "ich", "auf", "ein"]}


def prose(rng, n, lang="en"):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 4))) for _ in range(n))


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def stays(texts):
    """The least id of each group that similar pairs connect, by brute force."""
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and root[i] != root[j] and alike(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i in texts if root[i] == i}


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(60, 200))
        rows.append((i, text))
        for j in range(rng.choice([0, 0, 1, 3])):
            w = text.split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string").repartition(5)
    kept = {r.doc_id: r.text for r in near_duplicates(docs).collect()}
    texts = dict(rows)
    assert set(kept) == stays(texts)
    twice = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "null id text here", "y")], docs.schema))
    again = [r.text for r in near_duplicates(twice).collect()]
    assert len(again) == len(set(again)) == len(kept) + 1 and "null id text here" in again
    assert near_duplicates(docs.limit(0)).count() == 0


def test_similar_texts_with_distant_fingerprints(spark):
    rng = random.Random(8)
    rows, far, i = [], 0, 0
    while far < 12:
        text = prose(rng, 120)
        w = text.split(" ")
        for at in rng.sample(range(len(w)), 2):
            w[at] = "changed"
        other = " ".join([*w, *prose(rng, 12).split(" ")]) if i % 2 else " ".join(w)
        i += 1
        data = np.frombuffer((text + other).encode(), np.uint8)
        a, b = fingerprints(data, np.array([0, len(text), len(data)]), 5)
        if alike(text, other) and int(a ^ b).bit_count() > 12:
            rows += [(2 * i, text), (2 * i + 1, other)]
            far += 1
    rows += [(100_000 + i, prose(rng, 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_duplicates(docs).collect()}
    assert kept == {i for i, _ in rows if i >= 100_000 or i % 2 == 0}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_recall_by_similarity(spark):
    """Of pairs in bands of similarity, those found: all from 0.8 on, none below."""
    rng, rows, pairs = random.Random(21), [], []
    for i in range(0, 700, 2):
        w = prose(rng, 150).split(" ")
        other = list(w)
        for at in rng.sample(range(150), rng.choice([0, 1, 1, 2, 2, 3, 3, 4])):
            other[at] = "changed"
        other += prose(rng, rng.choice([1, 3, 6, 12])).split(" ")
        rows += [(i, " ".join(w)), (i + 1, " ".join(other))]
        pairs.append((likeness(rows[-2][1], rows[-1][1]), i + 1))
    kept = {r.doc_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for low, high in ((0.8, 0.83), (0.83, 0.86), (0.86, 0.9), (0.9, 1.01)):
        some = [i for s, i in pairs if low <= s < high]
        assert len(some) > 15 and sum(i not in kept for i in some) == len(some)
    assert all(i in kept for s, i in pairs if s < 0.8)


def test_dense_group_and_shared_passages(spark):
    """Many near copies of one text, of which few are similar to each other, and many texts around one passage."""
    rng = random.Random(22)
    base, passage = prose(rng, 150).split(" "), prose(rng, 100)
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"edit{i}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: passage + " " + prose(rng, rng.randint(20, 40)) for i in range(60)}
    texts |= {2000 + i: " ".join(f"long{rng.randint(0, 99)}" for _ in range(20_000)) for i in range(2)}
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, root long, bands long").repartition(5)
    assert {r.doc_id for r in near_duplicates(docs).collect()} == stays({i: t for i, t in texts.items() if i < 2000}) | {2000, 2001}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    where = tmp_path_factory.mktemp("sf")
    passage, leak = prose(rng, 60), prose(rng, 40)
    rows = [(i, prose(rng, rng.randint(80, 200), rng.choice(["en", "de"]))) for i in range(80)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " tail")]
    rows += [(102 + k, prose(rng, 90) + "\n" + passage + "\n" + prose(rng, 90)) for k in range(3)]
    rows += [(110, prose(rng, 50) + " " + leak.upper() + " " + prose(rng, 50)), (111, "12 34"), (112, None)]
    docs = spark.createDataFrame([(i, t, "de" if t and "der" in t else "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(7, leak), (8, prose(rng, 30))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), dict(rows), passage


def test_stages(spark, folder):
    where, texts, passage = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        seen.append({r.doc_id: r for r in docs.collect()})
        if len(seen) < 5:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(texts) - set(seen[0]) == {111, 112}
    assert set(seen[0]) - set(seen[1]) == {100, 101}
    for i, r in seen[2].items():
        if 102 <= i <= 104:
            assert passage[20:-20] not in r.text and r.text.startswith(texts[i][:300])
        else:
            assert r.text == texts[i]
        assert r.n_chars == len(r.text)
    assert set(seen[2]) - set(seen[3]) == {110}
    for i, r in seen[4].items():
        assert r.decoded_sha256 == hashlib.sha256(seen[3][i].text.encode()).hexdigest() and r.n_tokens == len(r.ids.split(","))


def test_rows_without_an_id_of_their_own(spark, folder):
    where, texts, _ = folder
    rng = random.Random(11)
    leak = next(r.text for r in spark.read.parquet(f"{where}/benchmark.parquet").collect() if r.item_id == 7)
    same = " ".join(f"é{k}ü" for k in range(60))
    rows = [(None, "null id \ufffd stays " + prose(rng, 30), "a", "s1", 0), (1, prose(rng, 40), "b", "s2", 0), (1, prose(rng, 41) + " " + leak, "c", "s3", 0), (2, "a" + same + "a \ufffd", "d", "s4", 0), (3, "b" + same + "b", "e", "s5", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.source: r for r in corpus_pipeline.passages_removed(spark, docs, where).collect()}
    assert len(got) == corpus_pipeline.passages_removed(spark, docs, where).count() == 5
    for i, t, lang, source, _ in rows[:3]:
        assert (got[source].doc_id, got[source].text, got[source].lang) == (i, t, lang)
    assert got["s4"].text == "aa \ufffd" and got["s5"].text == "bb"
    assert {r.source for r in corpus_pipeline.decontaminated(spark, docs, where).collect()} == {"s1", "s2", "s4", "s5"}


def test_run_and_empty(spark, folder, tmp_path):
    where, texts, _ = folder
    assert {r.doc_id for r in corpus_pipeline.run(spark, where).collect()} == set(texts) - {100, 101, 110, 111, 112}
    empty = spark.read.parquet(f"{where}/documents.parquet").where(F.lit(False))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

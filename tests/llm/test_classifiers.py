"""Held-out accuracy and edge cases of the fitted operators, on texts made here."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import kneser_ney as kn
from passagework.llm import perplexity_rules as P
from passagework.llm.language_id import language_id
from passagework.llm.neighbour_quality import Voter, neighbour_quality
from passagework.llm.perplexity_rules import base_counts, perplexity_rules
from passagework.llm.sentence_toxicity import Scorer, noisy_or, sentence_toxicity, sentences

STEMS = {"aa": ["the", "and", "thing", "ever", "rest", "wh"], "bb": ["der", "und", "schen", "heit", "zu", "ich"], "cc": ["que", "los", "ción", "ado", "ña", "el"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) + rng.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        lang = rng.choice(list(STEMS))
        text, good, toxic = prose(rng, lang, rng.randint(20, 120)), rng.random() < 0.8, rng.random() < 0.3
        if not good:
            text = rng.choice([lambda t: t.replace(" ", "$$$ "), lambda t: " | ".join(t.split()), lambda t: " ".join([t.split()[0]] * 80), str.upper])(text)
        if toxic:
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["Moron", "scum.", "zzidiotic"])
            text = " ".join(words)
        rows.append((i, text, lang, int(good), int(toxic)))
    rows += [(600, None, None, None, None), (601, "", "aa", 1, 0), (602, "12 !? 34", None, None, None), (None, prose(rng, "bb", 50), "bb", None, None), (5, *rows[5][1:])]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, quality int, toxic int").repartition(4).cache()


def test_language(spark, documents):
    learn = F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False))
    docs = documents.withColumn("score", F.lit("clash")).withColumn("_text", F.lit("clash"))
    got = language_id(docs, learn, keep=("lang", "score")).toPandas()
    assert len(got) == docs.count() and list(got.columns) == ["doc_id", "lang", "lang_pred", "score", "rejected", "cross_entropy"]
    held = got[(got.doc_id % 4 == 2) & got.lang.notna() & (got.doc_id < 600)]
    assert (held.lang == held.lang_pred).mean() > 0.99 and not held.rejected.any()
    odd = got[got.doc_id.isin([600, 601, 602])]
    assert set(odd.lang_pred) == {"und"} and odd.rejected.all() and (odd.score == 0).all()
    assert got.score.between(0, 1).all()
    strange = spark.createDataFrame([(1, "qxzj vkwq pqzx jjqx " * 20, None)], "doc_id int, text string, lang string")
    assert language_id(documents.select("doc_id", "text", "lang").unionByName(strange.withColumn("doc_id", F.lit(9999))), learn).where("doc_id = 9999").first().rejected
    assert language_id(docs.limit(0), learn).count() == 0
    assert set(language_id(docs, F.lit(False)).toPandas().lang_pred) == {"und"}


@pytest.mark.parametrize("operator,label,bar", [(neighbour_quality, "quality", 0.97), (sentence_toxicity, "toxic", 0.95)])
def test_held_out(documents, operator, label, bar):
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    docs, labels = documents.select("doc_id", "text", F.lit(1).alias("score")), documents.select("doc_id", label).dropDuplicates(["doc_id"])
    got = operator(docs, labels, learn).join(labels, "doc_id").toPandas()
    held = got[(got.doc_id % 3 == 1) & (got.doc_id < 600)]
    assert ((held.score >= 0.5) == (held[label] == 1)).mean() > bar
    whole = operator(docs, labels, learn).toPandas()
    assert len(whole) == docs.count() and whole.score.between(0, 1).all()
    assert operator(docs.limit(0), labels, learn).count() == 0
    assert operator(docs, labels.limit(0), learn).select("score").distinct().count() == 1


def test_offending_sentences(documents):
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    labels = documents.select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = sentence_toxicity(documents, labels, learn).join(documents.select("doc_id", "text"), "doc_id").where("size(offending) > 0 and doc_id <> 5").collect()
    found = [r.text.encode()[o["start"] : o["end"]].decode().lower() for r in rows for o in r.offending]
    assert sum(any(w in x for w in ("moron", "scum", "zzidiotic")) for x in found) > 0.95 * len(found) > 50


def test_noisy_or_finds_the_feature():
    import numpy as np

    label = np.array([1, 0] * 50)
    doc = np.repeat(np.arange(100), 2)
    sentence = np.arange(200)
    feature = np.where((sentence % 2 == 0) & (label[doc] == 1), 0, 1)
    weights, _ = noisy_or(label, np.ones(100), np.full(100, 3), doc, sentence, feature, 2)
    assert weights[0] > weights[1] + 2


def test_base_counts():
    import re

    import numpy as np

    rng = random.Random(9)
    texts = ["", "a b c a b c", "x\n x\nx\n\n", "#*$ % & | <> é", "one", "a a a a"] + ["".join(rng.choices("ab \n#é", k=rng.randint(0, 60))) for _ in range(200)]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)))
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    assert list(map(tuple, base_counts(np.frombuffer(b"".join(data), np.uint8), offsets).tolist())) == want


def test_thue_morse_words_and_lines_differ():
    from passagework.llm.textbytes import Sums

    for n in (1024, 4096):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        other = one.translate(str.maketrans("ab", "ba"))
        data = [f"{one}\n{other}".encode(), f"{one} x y {other} x y".encode(), f"{one}\n{one}".encode()]
        offsets = np.cumsum([0, *map(len, data)])
        whole = np.frombuffer(b"".join(data), np.uint8)
        assert base_counts(whole, offsets)[:, 3:].tolist() == [[0, 0], [0, 0], [1, 0]]
        at = np.array([0, n + 1, offsets[1], offsets[2]])
        hashes = Sums(whole).of(at, at + n)
        assert len(set(hashes.tolist())) == 2 and hashes[0] == hashes[2] == hashes[3]
        assert Sums(whole[n + 1 :].copy()).of(np.array([0]), np.array([n]))[0] == hashes[1]


def test_perplexity_bands(documents):
    got = perplexity_rules(documents.withColumn("kept", F.lit(1))).join(documents.select("doc_id", "text", "quality"), "doc_id").toPandas()
    long = got[~got.base_failed]
    assert long[long.quality == 1].kept.mean() > 0.97
    assert not got[got.base_failed].kept.any() and got[got.doc_id == 600].base_failed.all()
    assert perplexity_rules(documents.limit(0)).count() == 0


def brute_kneser_ney(counts, alphabet, modified):
    """{gram (tuple of symbols): probability} from {gram of 4 symbols: count}, from the definition."""
    levels = [counts]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(g[1:] for g in levels[-1]))
    lower = {(): 1 / alphabet}
    for level in reversed(levels):
        n = [sum(c == r for c in level.values()) for r in range(6)]
        share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        if modified:
            cuts = [min(max(r - (r + 1) * share * n[r + 1] / n[r], 0.05), r - 0.05) if n[r] else r / 2 for r in (1, 2, 3)]
        else:
            cuts = [min(share if 0 < share < 1 else 0.5, 1)] * 3
        cut = lambda c: cuts[min(c, 3) - 1]  # noqa: B023, E731
        after = {}
        for g, c in level.items():
            after.setdefault(g[:-1], []).append(c)
        lower = {g: (c - cut(c)) / sum(after[g[:-1]]) + sum(map(cut, after[g[:-1]])) / sum(after[g[:-1]]) * lower[g[1:]] for g, c in level.items()}
    return lower


def test_both_kneser_ney_forms_against_brute_force(spark):
    rng = random.Random(2)
    texts = {"x": ["".join(rng.choices("abcde ", weights=[9, 5, 3, 2, 1, 4], k=rng.randint(1, 60))) for _ in range(30)], "हि": ["".join(rng.choices("किताब है Ж𝄞", k=40)) for _ in range(20)]}
    rows = spark.createDataFrame([(k, t) for k, v in texts.items() for t in v], "_name string, _text string").repartition(3)
    counts = kn.counted(rows, P.symbols)
    got = {(r.name, r.gram & (2**64 - 1)): r.chance for r in kn.log_probabilities(counts, 1 << 16).collect()}
    grams = kn.collected(counts)
    names, plain = kn.build(grams, 1 << 16, False)
    for k, v in texts.items():
        found = Counter()
        for t in v:
            symbols = [0, 0, 0, *(0xE000 + ord(c) % 6400 if ord(c) > 0xFFFF else ord(c) for c in t)]
            found.update(tuple(symbols[i : i + 4]) for i in range(len(t)))
        code = lambda g: sum(x << 16 * (3 - i) for i, x in enumerate(g))
        want = brute_kneser_ney(found, 1 << 16, True)
        assert {c for n, c in got if n == k} == {code(g) for g in found}
        assert all(abs(got[k, code(g)] - math.log(want[g])) < 1e-9 for g in found)
        want = brute_kneser_ney(found, 1 << 16, False)
        scored = plain.of(np.array([code(g) for g in found], np.uint64))[:, names.index(k)]
        assert np.abs(scored - [math.log(want[g]) for g in found]).max() < 1e-4


def test_perplexity_by_join_and_of_any_script(spark, documents, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices(["कि", "ता", "ब", "पा", "नी", "घ", "र", "च्चे"], k=3)) for _ in range(400)]
    rows = [(1000 + i, " ".join(rng.choices(words, k=150)), "hi") for i in range(60)] + [(2000, " ".join("".join(rng.choices("फऊठऔषझ", k=6)) for _ in range(100)), "hi"), (2001, "ॐ " + " ".join(f"{rng.choice(words)}{i}" for i in range(20_000)), "long")]
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    columns = ["doc_id", "n_words", "kept", "base_failed"]
    one = perplexity_rules(docs).toPandas().sort_values(["doc_id", "log_perplexity"]).reset_index(drop=True)
    monkeypatch.setattr(P, "BROADCAST", 0)
    other = perplexity_rules(docs).toPandas().sort_values(["doc_id", "log_perplexity"]).reset_index(drop=True)
    assert one[columns].equals(other[columns]) and np.allclose(one.log_perplexity, other.log_perplexity, equal_nan=True)
    hindi = one[one.doc_id.between(1000, 1999)]
    assert hindi.kept.mean() > 0.95 and one[one.doc_id == 2000].log_perplexity.item() > hindi.log_perplexity.max()


def test_votes_against_brute_force_with_ties():
    rng = np.random.default_rng(3)
    sample = np.abs(rng.normal(size=(400, 60))).astype(np.float32)
    sample[100:160] = sample[100]  # ties at the edge of the nearest
    labels, weights = rng.integers(0, 2, 400), rng.uniform(0.5, 2, 400)
    own = Voter(sample, labels, 0.5, weights)
    asked = np.concatenate([sample[95:165], np.abs(rng.normal(size=(50, 60))).astype(np.float32), np.zeros((1, 60), np.float32)])
    got = own.score(asked)
    for row, score in zip(asked[:-1], got):
        alike = (own.latent(row[None]) @ own.near.T)[0]
        near = np.argsort(-np.round(alike.astype(np.float64), 6), kind="stable")[:15]
        vote = np.maximum(alike[near], 1e-6) ** 8 * weights[near]
        assert abs(score - (vote * labels[near]).sum() / vote.sum()) < 0.02 or len(set(np.round(alike, 6))) < 350
    few = own.score(sample[100:160])
    assert np.allclose(few, few[0]) and got[-1] == 0.5


def test_noisy_or_against_brute_force_and_long_clean_texts(spark, documents):
    rng = random.Random(4)
    texts = ["Good day. You moron! fine", "", "no words", "one\ntwo two two. " * 5]
    data = [t.encode() for t in texts]
    weights = np.random.default_rng(1).normal(size=1 << 20).astype(np.float32)
    scorer = Scorer(weights, -3.0, 0.5)
    score, *_ = scorer.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for t, s in zip(data, score):
        features, sentence, doc, _, _ = sentences(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        clean = 1.0
        for k in range(len(doc)):
            clean *= 1 - 1 / (1 + math.exp(-(-3.0 + float(weights[features[:, sentence == k]].sum()))))
        assert abs(s - (1 - clean)) < 1e-5
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    labels = documents.select("doc_id", "toxic").dropDuplicates(["doc_id"])
    long = spark.createDataFrame([(9000 + i, ". ".join(prose(rng, lang, 12) for _ in range(1500))) for i, lang in enumerate(STEMS)], "doc_id int, text string")
    got = sentence_toxicity(documents.select("doc_id", "text").unionByName(long), labels, learn).where("doc_id >= 9000").toPandas()
    assert len(got) == 3 and got.score.max() < 0.5

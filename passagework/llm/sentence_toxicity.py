"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's logit is a bias plus the weights of its words and of their first four, five and six bytes (a
word that repeats the one before it counts once); a document is toxic unless none of its sentences is (noisy-or). Weights are fitted to the labels of
documents by gradient descent on that likelihood, over a bounded sample (SAMPLE documents a label) and all
hashed features whose log odds between the labels are over EVIDENCE standard errors above nought; others
have weight nought. The sentence scores then locate what offends. The bias is at most BIAS, so a clean text
of a thousand sentences still scores under 0.05.

Sentences end at . ! ? or a line break; a text without words has no sentence and score 0. Null texts count
as empty; a very long text is scored whole; null ids or labels teach nothing; repeated rows get equal scores; other columns are ignored; an
empty table gives an empty result; without both labels to learn from every score is the share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.sampling import labelled
from passagework.llm.textbytes import Sums, chunks, column_bytes, lowered, tidy

SAMPLE, BITS, EVIDENCE, BIAS, ROUNDS, CHUNK, OFFENDS = 4_000, 20, 3.0, -10.0, 400, 1_000_000, 0.5
PREFIXES = (4, 5, 6)
_inside = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """(features of each word, its sentence, document of each sentence, first and last byte of its words)."""
    inside = _inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | first[:-1]))
    end = np.flatnonzero(inside & (~np.append(inside[1:], False) | first[1:])) + 1
    sums = Sums(lowered(data))
    stop = (data == 46) | (data == 33) | (data == 63) | (data == 10) | first[:-1]
    number = np.cumsum(stop)[start] if len(start) else np.zeros(0, np.int64)
    whole = sums.of(start, end)
    again = np.concatenate(([False], (whole[1:] == whole[:-1]) & (number[1:] == number[:-1])))[: len(start)]
    start, end, number = start[~again], end[~again], number[~again]
    spread = np.uint64(64 - BITS)
    found = [sums.of(start, end) >> spread]
    for k, n in enumerate(PREFIXES):
        found.append(((sums.of(start, np.minimum(start + n, end)) + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)) >> spread)
    new = np.concatenate(([True], number[1:] != number[:-1])) if len(start) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start))[: len(begin)] - 1
    doc = np.searchsorted(offsets, start[begin], "right") - 1
    return np.stack(found).astype(np.int64), np.cumsum(new) - 1, doc, start[begin], end[last]


class Scorer:
    """weights: by hashed feature; without any, every document gets the prior."""

    def __init__(self, weights: np.ndarray | None, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """(score of each document; document, first byte, last byte and score of each offending sentence)."""
        n = len(offsets) - 1
        if self.weights is None:
            return np.full(n, self.prior), *(np.zeros(0, np.int64),) * 3, np.zeros(0)
        features, sentence, doc, start, end = sentences(data, offsets)
        logit = self.bias + np.bincount(sentence, self.weights[features].sum(axis=0), len(doc))
        total = np.bincount(doc, np.logaddexp(0, logit), n)
        chance = 1 / (1 + np.exp(-logit))
        bad = np.flatnonzero(chance >= OFFENDS)
        return -np.expm1(-total), doc[bad], start[bad] - offsets[doc[bad]], end[bad] - offsets[doc[bad]], chance[bad]


def noisy_or(label: np.ndarray, weight: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(weights of n features, bias) that maximise the weighted likelihood.

    plain: sentences of each document without any feature; doc: document of each other sentence;
    sentence, feature: where a feature occurs."""
    at = np.concatenate((np.zeros(n), [BIAS]))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    weight = weight / weight.sum()
    for step in range(1, ROUNDS + 1):
        logit = at[-1] + np.bincount(sentence, at[feature], len(doc))
        total = np.bincount(doc, np.logaddexp(0, logit), len(label)) + plain * np.logaddexp(0, at[-1])
        total = np.maximum(total, 1e-9)
        slope = weight * np.where(label == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        each = slope[doc] / (1 + np.exp(-logit))
        gradient = np.append(np.bincount(feature, each[sentence], n), each.sum() + (slope * plain).sum() / (1 + np.exp(-at[-1])))
        gradient[:-1] += 1e-6 * at[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        at = at - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        at[-1] = min(at[-1], BIAS)
    return at[:-1], float(at[-1])


def fit(rows: DataFrame, counts: dict[int, int]) -> Scorer:
    """From a sample with _text and _label, and how many rows have each label."""
    if len(counts) < 2:
        return Scorer(None, 0.0, float(1 in counts))
    few = rows.select("_label", "_text")

    def counted(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column(0).to_numpy()
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                features, sentence, doc, _, _ = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pair = np.unique((doc[sentence] << BITS) + features)
                np.add.at(total, (label[i + (pair >> BITS)], pair & ((1 << BITS) - 1)), 1)
        some = np.flatnonzero(total.any(axis=0))
        for k in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 100_000]), pa.array(total[0, some[k : k + 100_000]]), pa.array(total[1, some[k : k + 100_000]])], ["feature", "zero", "one"])

    sampled = {int(r[0]): r[1] for r in few.groupBy("_label").count().collect()}
    zero, one = max(sampled.get(0, 0), 1), max(sampled.get(1, 0), 1)
    seen = few.mapInArrow(tidy(counted), "feature bigint, zero int, one int").groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    odds = (F.col("one") + 0.5) / (one + 1) / ((F.col("zero") + 0.5) / (zero + 1))
    error = F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    best = seen.where(F.log(odds) > EVIDENCE * error).select("feature").toPandas()
    chosen = np.sort(best["feature"].to_numpy().astype(np.int64))
    where = np.full(1 << BITS, -1, np.int32)
    where[chosen] = np.arange(len(chosen))

    def picked(batches):
        for batch in batches:
            label = batch.column(0).to_numpy()
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                features, sentence, doc, _, _ = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                index = where[features]
                row, word = np.nonzero(index >= 0)
                own = sentence[word]
                each = [[] for _ in range(j - i)]
                for d, s, f in zip(doc[own].tolist(), own.tolist(), index[row, word].tolist()):
                    each[d].append((s, f))
                yield pa.RecordBatch.from_arrays([pa.array(label[i:j]), pa.array(np.bincount(doc, minlength=j - i)), pa.array([[s for s, _ in x] for x in each], pa.list_(pa.int64())), pa.array([[f for _, f in x] for x in each], pa.list_(pa.int64()))], ["label", "n", "sentence", "feature"])

    got = few.mapInArrow(tidy(picked), "label int, n bigint, sentence array<bigint>, feature array<bigint>").toPandas()
    doc, sentence, feature, plain = [], [], [], []
    for d, (n, own, f) in enumerate(zip(got["n"], got["sentence"], got["feature"])):
        kinds, inverse = np.unique(np.asarray(own, np.int64), return_inverse=True)
        sentence.append(len(doc) + inverse)
        feature.append(np.asarray(f, np.int64))
        doc += [d] * len(kinds)
        plain.append(n - len(kinds))
    label = got["label"].to_numpy()
    weight = np.array([counts[0] / zero, counts[1] / one])[label]
    if not len(chosen):
        return Scorer(None, 0.0, counts[1] / sum(counts.values()))
    found, bias = noisy_or(label, weight, np.array(plain), np.array(doc, np.int64), np.concatenate(sentence), np.concatenate(feature), len(chosen))
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = found
    return Scorer(weights, bias, counts[1] / sum(counts.values()))


def sentence_toxicity(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), offending (byte range and score of each offending sentence)."""
    own = fit(*labelled(docs, labels, learn, id_col, text_col, label_col, SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                score, doc, start, end, chance = shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(chance)], ["start", "end", "score"])
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), listed], ["_id", "score", "offending"])

    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return few.mapInArrow(tidy(run), f"_id {dict(few.dtypes)['_id']}, score double, offending array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("_id", id_col)

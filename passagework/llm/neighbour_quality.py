"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed byte trigrams, trigrams of character kinds, and words that repeat the one before;
their root shares make a vector. The right singular vectors of a bounded sample of
labelled texts (SAMPLE a label) project it to DIMENSIONS latent dimensions. The sample's latent vectors are
broadcast - at most 2 * SAMPLE of them, whatever the corpus - and each text gets its exact cosine with all
of them, block by block. The NEIGHBOURS nearest vote for their labels with the power SHARPNESS of their
similarity, and votes are weighted so that the sample stands for the labelled rows.

A null or empty text has no vector and gets the share of label 1; so do all texts if only one label was
seen; with no labels at all the score is 0.5. Ties between neighbours go to the first in the sample, which
is in order of label and vector. A very long text is one vector like any other.
Rows with null ids or labels are scored and teach nothing if their label is null; repeated rows get equal
scores; a repeated label row would count twice; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.sampling import labelled
from passagework.llm.textbytes import Sums, chunks, column_bytes, starts, tidy, words

SAMPLE, TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS, CHUNK = 1_500, 2_048, 48, 15, 8, 1_000_000
_kinds = np.array([0 if c in b" \t\r\v\f" else 1 if c == 10 else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 6 if c in b".,;:'\"-()" else 7 if c < 128 else 5 for c in range(256)], np.int64)
WIDTH = TERMS + 512 + 1


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH root shares for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) > 2:
        doc, _ = starts(data, offsets)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        wide = data.astype(np.uint32)
        gram = (wide[at] << np.uint32(16)) | (wide[at + 1] << np.uint32(8)) | wide[at + 2]
        term = (gram * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
        kind = _kinds[data]
        kind = kind[at] * 64 + kind[at + 1] * 8 + kind[at + 2]
        doc = doc[at]
        total = np.maximum(size - 2, 1)[:, None]
        out[:, :TERMS] = np.sqrt(np.bincount(doc * TERMS + term, minlength=n * TERMS).reshape(n, TERMS) / total)
        out[:, TERMS : TERMS + 512] = 1.5 * np.sqrt(np.bincount(doc * 512 + kind, minlength=n * 512).reshape(n, 512) / total)
    start, end, of = words(data, offsets)
    if len(start) > 1:
        word = Sums(data).of(start, end)
        doc = np.repeat(np.arange(n), np.diff(of))
        again = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        share = np.bincount(doc[1:][again], minlength=n) / np.maximum(np.diff(of), 1)
        out[:, -1] = 3 * np.sqrt(share)
    return out


class Voter:
    def __init__(self, sample: np.ndarray, labels: np.ndarray, prior: float, weights: np.ndarray):
        self.prior, self.labels = prior, labels.astype(np.float32)
        self.weights = weights.astype(np.float32)
        self.ready = len(labels) > 1 and labels.min() != labels.max()
        if self.ready:
            _, axes = np.linalg.eigh((sample.T @ sample).astype(np.float64))
            self.axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
            self.near = self.latent(sample)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        found = rows @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        some = np.flatnonzero(rows.any(axis=1)) if self.ready else np.zeros(0, np.int64)
        for k in range(0, len(some), 512):
            block = some[k : k + 512]
            alike = self.latent(rows[block]) @ self.near.T
            most = min(NEIGHBOURS, alike.shape[1])
            last = -np.partition(-alike, most - 1, axis=1)[:, most - 1 : most]
            above, tied = alike > last, alike == last
            room = most - above.sum(axis=1, keepdims=True)
            top = np.nonzero(above | (tied & (tied.cumsum(axis=1) <= room)))[1].reshape(len(block), most)
            vote = np.maximum(np.take_along_axis(alike, top, 1), 1e-6) ** SHARPNESS * self.weights[top]
            out[block] = (vote * self.labels[top]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(rows: DataFrame, counts: dict[int, int]) -> Voter:
    """From a sample with _text and _label, and how many rows have each label."""
    total = sum(counts.values())
    if not total:
        return Voter(np.zeros((0, WIDTH), np.float32), np.zeros(0), 0.5, np.zeros(0))

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                found = vectors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in found], pa.binary())], ["label", "vector"])

    got = rows.select("_label", "_text").mapInArrow(tidy(run), "label int, vector binary").toPandas().sort_values(["label", "vector"])
    labels = got["label"].to_numpy()
    sample = np.frombuffer(b"".join(got["vector"]), np.float32).reshape(len(labels), WIDTH)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    weights = np.array([counts.get(k, 0) / total / max(share[k], 1e-9) for k in (0, 1)])
    return Voter(sample, labels, counts.get(1, 0) / total, weights[labels])


def neighbour_quality(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, score (0 to 1).

    labels: id and label_col (0 or 1); learn: a Column over docs, true for rows whose labels may be learned."""
    own = fit(*labelled(docs, labels, learn, id_col, text_col, label_col, SAMPLE))
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                for a in range(i, j, 1024):
                    b = min(a + 1024, j)
                    score = shared.value.score(vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score.astype(np.float64))], ["_id", "score"])

    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return few.mapInArrow(tidy(run), f"_id {dict(few.dtypes)['_id']}, score double").withColumnRenamed("_id", id_col)

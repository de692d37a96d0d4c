"""Language by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased letters with one space for anything between; each model gives its cross-entropy per
symbol, and the least wins. A language's rejection limit comes from texts that no model was fitted on (one
text in HOLD, by hash): their median cross-entropy, plus SLACK, plus DEVIATIONS times their scaled deviation
over the root of the length, so short texts may stray further; without such texts there is no limit. The
models hold about SAMPLE different texts a language, the limits about HELD, with all their grams.

A null text, or one without letters, is `und` with score 0 and is rejected; a null id or language is
allowed (the latter teaches nothing); ties go to the first language in order; a very long text is read
whole; repeated rows give equal rows and teach once; other columns are ignored unless they are listed in `keep`; with nothing to learn from, all texts
are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import kneser_ney as kn
from passagework.llm.sampling import bounded
from passagework.llm.textbytes import chunks, column_bytes, starts, tidy

#: Texts a language for its model and for its limit; one text in HOLD is for limits.
SAMPLE, HELD, HOLD = 1_500, 400, 5
SLACK, DEVIATIONS, EVIDENCE, ALPHABET = 0.7, 6.0, 40, 1 << 16
UNDETERMINED = "und"
_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Symbol of each code point: a letter or mark its lower-case form, 1 for the rest."""
    if not _tables:
        table = np.ones(0x110000, np.uint16)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                table[point] = min(max(ord(c.lower()[0]), 3), 0xFFFF)
            elif unicodedata.category(c)[0] == "M":
                table[point] = min(point, 0xFFFF)
        _tables.append(table)
        letter = np.array([chr(p).isalpha() for p in range(0x110000)])
        _tables.append(letter)
    return _tables[0]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): runs of what is no letter become one space."""
    points, at = kn.code_points(data, offsets)
    found = _table()[points]
    space = found == 1
    again = np.concatenate(([False], space[1:] & space[:-1]))
    again[at[:-1][at[:-1] < len(again)]] = False
    keep = ~again
    return found[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    _table()
    points, at = kn.code_points(data, offsets)
    return np.diff(np.concatenate(([0], np.cumsum(_tables[1][points])))[at])


def entropies(model: kn.Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per symbol for each text and model, symbols)."""
    found, at = symbols(data, offsets)
    size = np.diff(at)
    out = np.zeros((len(size), len(model.floor)))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = -np.add.reduceat(model.of(kn.gram_codes(found, at)), at[:-1][some], axis=0, dtype=np.float64) / size[some, None]
    return out, size


class Identifier:
    def __init__(self, names: list[str], model: kn.Model | None, limits: np.ndarray, spread: np.ndarray):
        self.names, self.model, self.limits, self.spread = names, model, limits, spread

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """(language, score, rejected, cross-entropy of the best)."""
        n = len(offsets) - 1
        if self.model is None:
            return [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool), np.zeros(n)
        bits, size = entropies(self.model, data, offsets)
        best = bits.argmin(axis=1)
        least = bits[np.arange(n), best]
        odds = np.exp(-np.minimum(size, EVIDENCE)[:, None] * (bits - least[:, None]))
        none = letters(data, offsets) == 0
        limit = self.limits[best] + DEVIATIONS * self.spread[best] / np.sqrt(np.maximum(size, 1))
        return [UNDETERMINED if z else self.names[b] for b, z in zip(best, none)], np.where(none, 0.0, 1 / odds.sum(axis=1)), none | (least > limit), least


def fit(rows: DataFrame) -> Identifier:
    """From rows with _text and _name (language)."""
    rows = rows.where("_name is not null and _text is not null")
    apart = F.pmod(F.xxhash64("_text", F.lit(9)), F.lit(HOLD)) == 0
    names, model = kn.build(kn.collected(kn.counted(bounded(rows.where(~apart), "_name", SAMPLE), symbols)), ALPHABET, False) if rows.limit(1).count() else ([], None)
    if not names:
        return Identifier([], None, np.zeros(0), np.zeros(0))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, kn.CHUNK):
                bits, size = entropies(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = np.array([names.index(x) if x in names else -1 for x in batch.column(0).slice(i, j - i).to_pylist()])
                ok = (own >= 0) & (size > 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(bits[ok, own[ok]]), pa.array(size[ok])], ["own", "bits", "size"])

    held = bounded(rows.where(apart), "_name", HELD, salt=1).select("_name", "_text").mapInArrow(tidy(measured), "own bigint, bits double, size bigint").toPandas()
    limits, spread = np.full(len(names), np.inf), np.zeros(len(names))
    for k, g in held.groupby("own"):
        middle = g["bits"].median()
        limits[k], spread[k] = middle + SLACK, 1.4826 * ((g["bits"] - middle).abs() * np.sqrt(g["size"])).median()
    return Identifier(names, model, limits, spread)


def language_id(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of `keep`, lang_pred, score (0 to 1), rejected, cross_entropy (nats a symbol).

    learn: a Column, true for rows that the models may be fitted on."""
    text = F.col(text_col).cast("string").alias("_text")
    own = fit(docs.where(learn).select(text, F.col(lang_col).cast("string").alias("_name")))
    shared = docs.sparkSession.sparkContext.broadcast(own)
    more = [c for c in keep if c not in ("lang_pred", "score", "rejected", "cross_entropy")]
    few = docs.select(F.col(id_col).alias("_id"), text, *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(more)))

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, kn.CHUNK):
                name, score, rejected, bits = shared.value.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kept = [batch.column(k).slice(i, j - i) for k in (0, *range(2, 2 + len(more)))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(name, pa.string()), pa.array(score), pa.array(rejected), pa.array(bits)], names)

    kinds = dict(few.dtypes)
    names = ["_id", *(f"_keep_{i}" for i in range(len(more))), "lang_pred", "score", "rejected", "cross_entropy"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names if c in kinds), "lang_pred string, score double, rejected boolean, cross_entropy double"])
    made = few.mapInArrow(tidy(run), schema)
    return made.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(more)), "lang_pred", "score", "rejected", "cross_entropy")

"""Quality rules, and a character n-gram perplexity that must lie within its language's band.

The modified Kneser-Ney models of character 4-grams are counted and computed by Spark over all texts, one per
value of the language column. A character is its code point (those beyond 16 bits share the 6,400 private
ones), so every script is judged. As all texts are counted, each gram of a text has a probability; up to
BROADCAST grams in all, these are broadcast as sorted hash arrays, and beyond it texts are scored by a join
with the same results. A language's band reaches WIDTH robust deviations to either side of the median log
perplexity of its texts that pass the rules, but never less than NARROW; the deviation is taken from the
quartiles.

A null text has no words and fails; a null language is a language of its own; a very long text is read whole;
equal rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import kneser_ney as kn
from passagework.llm import storage
from passagework.llm.textbytes import Sums, chunks, column_bytes, mixed, tidy, words

BROADCAST, WIDTH, NARROW, MIN_WORDS, MAX_REPEATS = 4_000_000, 6.0, 0.15, 50, 50
SYMBOLS = b"#*$%&|<>"


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols from 1 on, offsets): code points in 16 bits."""
    points, at = kn.code_points(data, offsets)
    return np.where(points > 0xFFFF, 0xE000 + points % 6400, np.maximum(points, 1)).astype(np.uint16), at


def base_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, as columns."""
    start, end, of = words(data, offsets)
    n, size = len(offsets) - 1, np.diff(of)
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = size
    whole = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    doc = np.repeat(np.arange(n), size)
    out[:, 1] = np.bincount(doc, whole[end] - whole[start], n)
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    out[:, 2] = np.diff(np.concatenate(([0], np.cumsum(table[data])))[offsets])
    sums = Sums(data)
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate((offsets[:-1], breaks + 1))
    stop = np.concatenate((breaks, offsets[1:]))
    line_doc = np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((begin, line_doc))
    begin, line_doc = begin[order], line_doc[order]
    stop = np.sort(stop)
    full = np.searchsorted(start, begin) < np.searchsorted(start, stop)
    key = mixed(sums.of(begin[full], stop[full]) + mixed(line_doc[full].astype(np.uint64)))
    owner = line_doc[full]
    _, first = np.unique(key, return_index=True)
    out[:, 3] = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
    if len(start) > 2:
        word = sums.of(start, end)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        key = mixed(mixed(word[at] + mixed(doc[at].astype(np.uint64))) + word[at + 1] * np.uint64(3) + mixed(word[at + 2]))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        hit = np.zeros(len(start), bool)
        for k in range(3):
            hit[again + k] = True
        out[:, 4] = np.bincount(doc[hit], minlength=n)
    return out


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Table:
    """Log probabilities of the grams of each language, by hash."""

    def __init__(self, chances: DataFrame):
        self.of_name = {}
        for (name,) in chances.select("name").distinct().collect():
            rows = chances.where(F.col("name") == name).select("gram", "chance").toArrow()
            keys = kn.SortedHashes(rows["gram"].to_numpy().view(np.uint64), 4)
            self.of_name[name] = keys, rows["chance"].to_numpy()[keys.order]
            keys.order = None

    def of(self, name: str, codes: np.ndarray) -> np.ndarray:
        keys, chance = self.of_name[name]
        return chance[keys.find(codes)]


def _scored(table):
    """Base counts of each text, and with a broadcast table its log perplexity."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets, kn.CHUNK):
                text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                name = batch.column(1).slice(i, j - i)
                found, place = symbols(text, at)
                size, mean = np.diff(place), np.zeros(j - i)
                if table is not None:
                    listed = np.array(name.to_pylist(), object)
                    codes, which = kn.gram_codes(found, place), np.repeat(np.arange(j - i), np.diff(place))
                    chance = np.zeros(len(codes))
                    for lang in set(listed):
                        own = (listed == lang)[which]
                        if own.any():
                            chance[own] = table.value.of(lang, codes[own])
                    mean = np.bincount(which, -chance, j - i) / np.maximum(size, 1)
                base = base_counts(text, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), name, *(pa.array(c) for c in base.T), pa.array(mean, mask=(size == 0) | (table is None)), *(c.slice(i, j - i) for c in batch.columns[3:])], ["_id", "_name", *RESULT, "log_perplexity", *batch.schema.names[3:]])

    return run


def _grams(batches):
    """(_row, name, gram, n): the distinct grams of each text."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(2))
        for i, j in chunks(offsets, kn.CHUNK):
            found, place = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            codes = kn.gram_codes(found, place)
            for k, (a, b) in enumerate(zip(place[:-1], place[1:])):
                kinds, n = np.unique(codes[a:b], return_counts=True)
                if len(kinds):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(3)[i + k].as_py()] * len(kinds), pa.int64()), pa.array([batch.column(1)[i + k].as_py()] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n)], ["_row", "name", "gram", "n"])


def perplexity_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, the five counts, base_failed, log_perplexity (nats a character, null without text), lower, upper, kept."""
    few = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_name"), F.col(text_col).cast("string").alias("_text"))
    counts = storage.saved(kn.counted(few, symbols), "grams")
    chances = storage.saved(kn.log_probabilities(counts, 1 << 16), "chances")
    schema = f"_id {dict(few.dtypes)['_id']}, _name string, " + ", ".join(f"{c} bigint" for c in RESULT) + ", log_perplexity double"
    if chances.count() <= BROADCAST:
        table = few.sparkSession.sparkContext.broadcast(Table(chances))
        scored = few.mapInArrow(tidy(_scored(table)), schema)
    else:
        rows = storage.saved(few.withColumn("_row", F.monotonically_increasing_id()), "rows")
        asked = rows.mapInArrow(tidy(_grams), "_row bigint, name string, gram bigint, n bigint").join(chances, ["name", "gram"])
        mean = asked.groupBy("_row").agg((-F.sum(F.col("n") * F.col("chance")) / F.sum("n")).alias("log_perplexity"))
        scored = rows.mapInArrow(tidy(_scored(None)), schema + ", _row bigint").drop("log_perplexity").join(mean, "_row", "left").select("_id", "_name", *RESULT, "log_perplexity")
    scored = storage.saved(scored.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATS} * n_words")), "scored")
    storage.dropped(counts, chances)
    band = scored.where("not base_failed").groupBy("_name").agg(F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q"))
    reach = F.greatest(F.lit(NARROW), WIDTH * 0.7413 * (F.col("q")[2] - F.col("q")[0]))
    band = band.select("_name", (F.col("q")[1] - reach).alias("lower"), (F.col("q")[1] + reach).alias("upper"))
    joined = scored.join(band, "_name", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.select(F.col("_id").alias(id_col), *RESULT, "base_failed", "log_perplexity", "lower", "upper", kept.alias("kept"))

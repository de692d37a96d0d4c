"""Interpolated Kneser-Ney models of character 4-grams in sorted hash arrays.

A gram is four 16-bit symbols in one 64-bit code. A text is preceded by three boundary symbols, so each of
its symbols has a whole gram. All grams that were seen have their interpolated log probability stored;
for another, the stored weight of its context leads to the gram without its first symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.textbytes import chunks, column_bytes, mixed, starts, tidy

ORDER, CHUNK = 4, 500_000
MASKS = [np.uint64((1 << (16 * n)) - 1) for n in range(ORDER + 1)]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) of UTF-8 texts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, count[offsets]


def gram_codes(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of the gram that ends at each symbol; symbols from 1 on, 0 is the boundary."""
    which, _ = starts(symbols, offsets)
    padded = np.zeros(len(symbols) + (len(offsets) - 1) * (ORDER - 1), np.uint64)
    at = np.arange(len(symbols)) + (which + 1) * (ORDER - 1)
    padded[at] = symbols
    code = padded[at]
    for k in range(1, ORDER):
        code = code | padded[at - k] << np.uint64(16 * k)
    return code


class SortedHashes:
    """Where keys stand in an array sorted by hash; an index on the leading bits narrows the search."""

    def __init__(self, codes: np.ndarray, salt: int):
        self.salt = np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        keys = mixed(codes ^ self.salt)
        self.order = np.argsort(keys)
        self.bits = max(1, len(keys).bit_length())
        self.keys = np.append(keys[self.order], np.uint64(0))
        self.index = np.searchsorted(keys[self.order], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.most = int(np.diff(np.append(self.index, len(keys))).max(initial=0))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places in the sorted array, -1 for what it lacks."""
        keys = mixed(codes ^ self.salt)
        at = self.index[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        last = len(self.keys) - 1
        found = np.where((self.keys[at] == keys) & (at < last), at, -1)
        left = np.flatnonzero(found < 0)
        for k in range(1, self.most):
            spot = np.minimum(at[left] + k, last)
            hit = (self.keys[spot] == keys[left]) & (spot < last)
            found[left[hit]] = spot[hit]
            left = left[~hit]
        return found


def _discount(count: np.ndarray, modified: bool) -> np.ndarray:
    n = [float((count == r).sum()) for r in range(5)]
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    if not modified:
        return np.minimum(np.full(len(count), share if 0 < share < 1 else 0.5), count)
    steps = [min(max(r - (r + 1) * share * n[r + 1] / n[r], 0.05), r - 0.05) if n[r] else r / 2 for r in (1, 2, 3)]
    return np.array([0.0, *steps])[np.minimum(count, 3).astype(np.int64)]


class _One:
    """Levels of one model: (grams in order, log probability, contexts in order, log weight), from order 1 up."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int, modified: bool):
        order = np.argsort(codes)
        gram, count = codes[order], counts[order].astype(np.float64)
        raw = []
        for n in range(ORDER, 0, -1):
            cut = _discount(count, modified)
            context, which = np.unique(gram >> np.uint64(16), return_inverse=True)
            total = np.bincount(which, count, len(context))
            raw.append((gram, (count - cut) / total[which] if len(gram) else count, context, np.bincount(which, cut, len(context)) / total if len(gram) else total, which))
            gram, count = np.unique(gram & MASKS[n - 1], return_counts=True)
            count = count.astype(np.float64)
        self.levels: list[tuple] = []
        self.floor = float(np.log((raw[-1][3][0] if len(raw[-1][3]) else 1.0) / alphabet))
        for n, (gram, own, context, weight, which) in enumerate(reversed(raw), 1):
            lower = np.exp(self.floor) / max(raw[-1][3][0], 1e-300) if n == 1 and len(gram) else 0.0
            if n > 1 and len(gram):
                below, chance = self.levels[-1][:2]
                lower = np.exp(chance[np.searchsorted(below, gram & MASKS[n - 1])])
            probability = own + (weight[which] * lower if len(gram) else 0.0)
            self.levels.append((gram, np.log(np.maximum(probability, 1e-300)), context, np.log(np.maximum(weight, 1e-300))))

    def of(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Log probability of grams of n symbols."""
        if n == 0:
            return np.full(len(codes), self.floor)
        gram, chance, _, _ = self.levels[n - 1]
        at = np.minimum(np.searchsorted(gram, codes), max(len(gram) - 1, 0))
        seen = gram[at] == codes if len(gram) else np.zeros(len(codes), bool)
        out = np.empty(len(codes))
        out[seen] = chance[at[seen]]
        rest = codes[~seen]
        out[~seen] = self.of(rest & MASKS[n - 1], n - 1) + (self.weight(rest >> np.uint64(16), n) if n > 1 else 0.0)
        return out

    def weight(self, contexts: np.ndarray, n: int) -> np.ndarray:
        _, _, context, weight = self.levels[n - 1]
        at = np.minimum(np.searchsorted(context, contexts), max(len(context) - 1, 0))
        return np.where(context[at] == contexts, weight[at], 0.0) if len(context) else np.zeros(len(contexts))


class Model:
    """Log probabilities under several models at once: one column for each."""

    def __init__(self, models: list[_One]):
        self.floor = np.array([m.floor for m in models], np.float32)
        self.levels = []
        for n in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([m.levels[n - 1][0] for m in models]))
            contexts = np.unique(np.concatenate([m.levels[n - 1][2] for m in models]))
            keys, heads = SortedHashes(grams, n), SortedHashes(contexts, 100 + n)
            table = np.stack([m.of(grams, n)[keys.order] for m in models], 1).astype(np.float32)
            weights = np.stack([m.weight(contexts, n)[heads.order] for m in models], 1).astype(np.float32)
            keys.order = heads.order = None
            self.levels.append((keys, table, heads, np.vstack((weights, np.zeros((1, len(models)), np.float32)))))

    def of(self, codes: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.floor, (len(codes), len(self.floor)))
        keys, table, heads, weights = self.levels[n - 1]
        at = keys.find(codes)
        out = table[at] if len(table) else np.zeros((len(codes), len(self.floor)), np.float32)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            lower = self.of(codes[rest] & MASKS[n - 1], n - 1)
            out[rest] = lower + weights[heads.find(codes[rest] >> np.uint64(16))] if n > 1 else lower
        return out


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int, modified: bool) -> tuple[list[str], Model]:
    """(names, model with a column for each) from the codes and counts of each name."""
    names = sorted(grams)
    return names, Model([_One(*grams[name], alphabet, modified) for name in names])


def counted(texts: DataFrame, symbols) -> DataFrame:
    """(name, code, n): how often each gram occurs in the texts of a name; columns _name and _text.

    Each task adds up its own texts first, so what is shuffled follows the distinct grams."""

    def run(batches):
        kept: dict[str, list] = {}
        held = 0

        def merged(parts):
            codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                found, at = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                codes = gram_codes(found, at)
                which = np.repeat(np.arange(j - i), np.diff(at))
                for name in set(names[i:j]):
                    own = np.array([x == name for x in names[i:j]], bool)
                    some, n = np.unique(codes[own[which]] if not own.all() else codes, return_counts=True)
                    kept.setdefault(name, []).append((some, n))
                    held += len(some)
                if held > 2_000_000:
                    kept = {k: [merged(v)] for k, v in kept.items()}
                    held = 0
        for name, parts in kept.items():
            codes, n = merged(parts)
            for k in range(0, len(codes), 100_000):
                some = codes[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(n[k : k + 100_000])], ["name", "code", "n"])

    rows = texts.select("_name", "_text").mapInArrow(tidy(run), "name string, code bigint, n bigint")
    return rows.groupBy("name", "code").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The counts by name, on the driver: only for the grams of a bounded sample."""
    got = counts.toPandas()
    return {name: (g["code"].to_numpy().astype(np.int64).view(np.uint64), g["n"].to_numpy()) for name, g in got.groupby("name")}


def _discounted(level: DataFrame) -> DataFrame:
    """level (name, gram, c) with cut, what modified Kneser-Ney takes from c, from the counts of counts of each name."""
    often = level.groupBy("name").agg(*(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, 5)))
    share = F.expr("if(n1 > 0, n1 / (n1 + 2 * n2), 0.5D)")
    cuts = [F.expr(f"if(n{r} > 0, least(greatest({r} - {r + 1} * share * n{r + 1} / n{r}, 0.05D), {r} - 0.05D), {r} / 2D)").alias(f"d{r}") for r in (1, 2, 3)]
    return level.join(often.withColumn("share", share).select("name", *cuts), "name").withColumn("cut", F.expr("case c when 1 then d1 when 2 then d2 else d3 end")).select("name", "gram", "c", "cut")


def log_probabilities(counts: DataFrame, alphabet: int) -> DataFrame:
    """(name, gram, chance): the interpolated modified Kneser-Ney log probability of each gram of ORDER symbols in counts (name, code, n).

    All of it is grouped sums and joins on grams, so a model may be of any size."""
    levels = [counts.select("name", F.col("code").alias("gram"), F.col("n").alias("c"))]
    for n in range(ORDER - 1, 0, -1):
        level = levels[-1].select("name", F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")).groupBy("name", "gram").agg(F.count(F.lit(1)).alias("c"))
        levels.append(storage.saved(level, f"counts{n}"))
    lower = None
    for n, level in enumerate(reversed(levels), 1):
        some = _discounted(level).withColumn("head", F.expr("shiftrightunsigned(gram, 16)"))
        heads = some.groupBy("name", "head").agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        some = some.join(heads, ["name", "head"])
        if lower is None:
            some = some.withColumn("below", F.lit(1.0 / alphabet))
        else:
            some = some.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))).join(lower.select("name", F.col("gram").alias("tail"), F.col("chance").alias("below")), ["name", "tail"])
        before, lower = lower, storage.saved(some.select("name", "gram", F.expr("(c - cut) / total + left / total * below").alias("chance")), f"order{n}")
        if before is not None:
            storage.dropped(before)
    storage.dropped(*levels[1:])
    return lower.select("name", "gram", F.log("chance").alias("chance"))

"""Katz back-off word model of any order: Good-Turing discounts, exactly normalised back-off weights.

Texts become batches of token numbers, stored once, bucketed by batch. The counts of each order live in
tables that are partitioned by the hash of a word, or of a history. A batch asks each partition once for the
words or n-grams that it has; a partition adds up what all batches have counted and answers every batch in
the order in which it asked. So a token costs no join row, and what is shuffled grows with the distinct
n-grams of a batch of text. A history with over SPLIT tokens is dealt over several partitions by the
following word, and only the sums for its back-off weight are put together.

P(w | h) = d(c(h, w)) c(h, w) / c(h) for an n-gram that was seen, else alpha(h) P(w | h without its first
word), down to P(w) = d(c(w)) c(w) / N for a known word, and the mass left is that of the one unknown word.
Every n-gram seen is stored; a history never seen backs off with weight 1. Orders are evaluated one after
the other: an n-gram asks with what gives its probability one order below, so that a partition can add up
the exact back-off mass of a history. Every distribution adds up to 1 over the known words, the end
and the unknown word. Before a text there are order - 1 signs of its beginning. Words and histories
are told apart by 64-bit hashes, followers of a history by numbers that the word partitions deal out.

Null texts are empty (one token: the end); a null id counts as not held out; repeated rows count twice;
a text longer than CHUNK is a batch of its own; columns other than id and text are ignored; an empty table
gives an empty result. Without any training text all words are unknown. What is broadcast or collected is
a few numbers for each order.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.textbytes import Sums, bundled, chunks, column_bytes, hold, lowered, mixed, release, starts, tidy, unbundled, words

#: Words in an n-gram.
ORDER = 3
#: Bytes of text in a batch, and of those that are hashed at once; hashes that stand for the end of a text and for its beginning.
CHUNK, PIECE, END, BEGIN = 2_500_000, 1_000_000, 1, 2
#: Up to which count discounts hold.
DISCOUNTED = 5
#: Tokens of one history in a partition; words, and tokens whose n-grams are asked for, in a partition.
SPLIT, WORDS, PAIRS = 250_000, 500_000, 500_000
#: Bytes of free memory that a worker keeps while it works.
HELD = 1 << 27
#: Bytes that go to a Python worker at once.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def discounts(times: np.ndarray) -> np.ndarray:
    """d(0..DISCOUNTED) by Good-Turing from the numbers of kinds seen 1..DISCOUNTED + 1 times; r / (r + 1) where that fails."""
    k, n = DISCOUNTED, [0.0, *map(float, times)]
    out = np.array([0.0, *(r / (r + 1) for r in range(1, k + 1))])
    if n[1] > 0:
        top = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and top < 1:
                d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top)
                if 0 < d < 1:
                    out[r] = d
    return out


def discounted(count: np.ndarray, table: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return np.append(table, 1.0)[np.minimum(count, DISCOUNTED + 1)] * count


class Unigrams:
    def __init__(self, total: int, kinds: int, times: list[int]):
        self.total, self.kinds, self.table = total, kinds, discounts(np.array(times))
        seen = sum((self.table[r] - 1) * r * times[r - 1] for r in range(1, DISCOUNTED + 1)) + total
        self.below = total if seen < total else total + 1
        self.unknown = 1 - seen / self.below

    def of(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.table) / self.below, self.unknown)


class Setting:
    """What is known before an order is evaluated: training texts, partitions, the model of words, and the discounts of orders 2 and up."""

    def __init__(self, texts: int, word_parts: int, parts: int, model: Unigrams):
        self.texts, self.word_parts, self.parts, self.model = texts, word_parts, parts, model
        self.tables: list[np.ndarray] = []


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values in order, np.argsort(values, kind="stable")) of 64-bit values without a sign: one sort of their upper bits with their places below."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    bits = len(values).bit_length()
    spare = max(0, int(values.max()).bit_length() + bits - 64)
    both = values << np.uint64(bits) if not spare else values >> np.uint64(spare) << np.uint64(bits)
    both |= np.arange(len(values), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
    if not spare:
        return both >> np.uint64(bits), order
    found = values[order]
    if (found[1:] < found[:-1]).any():  # equal in the upper bits only
        order = np.argsort(values, kind="stable")
        found = values[order]
    return found, order


def _pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(np.lexsort((low, high)), where in it a new pair begins, high and low of the different pairs) of 64-bit values without a sign."""
    bits, room = (int(x.max()).bit_length() if len(x) else 0 for x in (low, high))
    if bits + room + len(low).bit_length() <= 64:
        pair, order = _sorted(high << np.uint64(bits) | low)
        begin = _runs(pair)
        pair = pair[begin]
        return order, begin, pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)
    order = _sorted(low)[1]
    order = order[_sorted(high[order])[1]]
    begin = np.union1d(_runs(high[order]), _runs(low[order]))
    return order, begin, high[order[begin]], low[order[begin]]


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0 sizes[0] times, 1 sizes[1] times, ..."""
    return np.repeat(np.arange(len(sizes)), sizes)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of 64-bit values without a sign."""
    found, order = _sorted(values)
    begin = _runs(found)
    at = np.empty(len(values), np.int64)
    at[order] = _spread(np.diff(begin, append=len(values)))
    return found[begin], at


def _pieces(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(partition, from, to) of the runs of equal partitions."""
    edge = np.append(_runs(part), len(part))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:])]


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, which take fewer bytes; np.cumsum turns them back."""
    return np.diff(values, prepend=np.uint64(0))


#: Of a history: n-grams seen 1..DISCOUNTED times, tokens of the others, mass of its followers one order below.
SUMS = DISCOUNTED + 2


class Level:
    """The n-grams of one order in a batch: at, the n-gram that ends at each token; of each n-gram its probability
    and, unless no order follows, its name, its count, and what the discounted counts of its history are divided by."""

    def __init__(self, at: np.ndarray, name: np.ndarray | None, count: np.ndarray | None, chance: np.ndarray, base: np.ndarray | None):
        self.at, self.name, self.count, self.chance, self.base = at, name, count, chance, base


class Asked:
    """The n-grams of the next order, and those of them whose history was seen, in the order of their partitions."""

    def __init__(self, batch: "Batch", below: Level, order: int, set_: Setting):
        self.batch, self.below, self.order = batch, below, order
        m = len(below.count)
        history = np.concatenate(([m], below.at[:-1]))
        history[batch.first] = m
        self.place, self.fresh, history, word = _pairs(history.view(np.uint64), batch.token.view(np.uint64))
        history, self.word = history.view(np.int64), word.view(np.int64)
        self.at = np.empty(len(self.place), np.int64)
        self.at[self.place] = _spread(np.diff(self.fresh, append=len(self.place)))
        self.suffix = below.at[self.place[self.fresh]]
        name, seen = np.append(below.name, mixed(np.array([BEGIN + order], np.uint64))), np.append(below.count, set_.texts)
        begin = _runs(history)
        self.sizes, which = np.diff(begin, append=len(history)), history[begin]
        spot, seen, size = name[which], seen[which], self.sizes
        self.named = spot
        if (seen > SPLIT).any():  # the n-grams of these histories are dealt out one by one
            first = np.repeat(seen > SPLIT, size)
            first[begin] = True
            first = np.flatnonzero(first)
            run = np.searchsorted(begin, first, "right") - 1
            begin, size, seen, whole = first, np.diff(first, append=len(history)), seen[run], spot[run]
            shares, spot = -(-seen // SPLIT), whole.copy()
            split = shares > 1
            spot[split] = mixed(spot[split] + mixed(batch.number[self.word[begin[split]]]) % shares[split].astype(np.uint64) + np.uint64(1))
        else:
            whole, split = spot, None
        some = np.flatnonzero(seen > 0)
        self.spot, sorting = _sorted(spot[some])
        some = some[sorting]
        size = size[some]
        self.begin = np.cumsum(size) - size
        self.some = np.repeat(begin[some] - self.begin, size) + np.arange(size.sum())
        if split is not None:
            one = _runs(self.spot)
            self.begin, self.spot, some = self.begin[one], self.spot[one], some[one]
        self.length = np.diff(self.begin, append=len(self.some))
        self.split = split[some] if split is not None else np.zeros(len(some), bool)
        self.whole, self.seen = whole[some[self.split]], seen[some]

    def asking(self, low: int, high: int, parts: int) -> list[tuple[int, bytes]]:
        """What goes to each of the partitions from low to below high."""
        part = _part(self.spot, parts)
        i, j = np.searchsorted(part, (low, high))
        edge = np.append(self.begin, len(self.some))
        some = self.some[edge[i] : edge[j]]
        learned = self.batch.learned()[self.place]
        times = (np.add.reduceat(learned, self.fresh, dtype=np.uint32) if len(learned) else np.zeros(0, np.uint32))[some]
        follower, less, base = self.batch.number[self.word[some]], self.below.count[self.suffix[some]], self.below.base[self.suffix[self.some[self.begin[i:j]]]]
        length, splits, out = self.length.astype(np.uint32), np.cumsum(np.append(False, self.split)), []
        for p, a, b in _pieces(part[i:j]):
            x, y, own = edge[i + a] - edge[i], edge[i + b] - edge[i], slice(i + a, i + b)
            whole = self.whole[splits[i + a] : splits[i + b]]
            out.append((p, bundled(_steps(self.spot[own]), length[own], whole, self.split[own].view(np.uint8), base[a:b], follower[x:y], times[x:y], less[x:y])))
        return out

    def answered(self, row: dict, table: np.ndarray, last: bool) -> Level:
        chance, n = self.below.chance[self.suffix], len(self.word)
        name, count, base = (None, None, None) if last else (mixed(np.repeat(self.named, self.sizes) + mixed(self.batch.kinds + np.uint64(self.order))[self.word]), np.zeros(n, np.int64), np.ones(n, np.int64))
        if len(self.some):
            parts = [unbundled(x["blob"], np.uint64, np.uint8, np.float64) for x in sorted(row[f"answers{self.order}"], key=lambda x: x["part"])]
            found = np.concatenate([x[0] for x in parts]).view(np.int64)
            need = np.flatnonzero(np.concatenate([x[1] for x in parts]))
            sums = np.concatenate([x[2].reshape(SUMS, -1) for x in parts], axis=1)
            if self.split.any():
                shared = {x["name"]: x["share"] for x in row[f"shares{self.order}"]}
                need = np.concatenate((need, np.flatnonzero(self.split)))
                sums = np.concatenate((sums, np.array([shared[x] for x in self.whole.view(np.int64).tolist()]).T), axis=1)
            used = sum(table[r] * r * sums[r - 1] for r in range(1, DISCOUNTED + 1)) + sums[-2]
            below, back = self.seen.copy(), np.ones(len(self.seen))
            below[need] += used >= below[need] * (1 - 1e-12)
            back[need] = (1 - used / below[need]) / (1 - sums[-1])
            unseen = np.flatnonzero(found == 0)
            run = np.searchsorted(self.begin, unseen, "right") - 1
            less = back[run] * chance[self.some[unseen]]
            below = np.repeat(below, self.length)
            if not last:
                count[self.some], base[self.some] = found, below
            found = discounted(found, table)
            found /= below
            found[unseen] = less
            chance[self.some] = found
        return Level(self.at, name, count, chance, base)


class Batch:
    """Token numbers of some texts; kinds holds their hashes in order, number what tells them apart everywhere."""

    def __init__(self, row: dict):
        kinds, _, token = unbundled(row["blob"], np.uint64, np.uint32, np.uint32)
        self.kinds, self.token = np.cumsum(kinds, dtype=np.uint64), token.astype(np.int64)
        self.held = np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def learned(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def words(self, row: dict, model: Unigrams) -> Level:
        parts = [unbundled(x["blob"], np.uint64, np.uint64) for x in sorted(row["answers1"], key=lambda x: x["part"])]
        count, self.number = np.concatenate([x[0] for x in parts]).astype(np.int64), np.concatenate([x[1] for x in parts])
        return Level(self.token, self.kinds, count, model.of(count), np.full(len(count), model.below))

    def level(self, row: dict, order: int, set_: Setting, last: bool = False) -> Level:
        """The highest of the orders that have been answered; last: no order follows."""
        found = self.words(row, set_.model)
        for k in range(2, order + 1):
            found = Asked(self, found, k, set_).answered(row, set_.tables[k - 2], last and k == order)
        return found


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each text, hashes of the tokens)."""
    low = lowered(data)
    start, end, of = words(low, offsets)
    sizes = np.diff(of) + 1
    token = np.full(sizes.sum(), END, np.uint64)
    which, step = starts(low, of)
    token[(np.cumsum(sizes) - sizes)[which] + step] = Sums(low).of(start, end)
    return sizes, token


def _rows(batches):
    """Rows one at a time, as each holds a whole batch of text."""
    hold(HELD)
    for batch in batches:
        for k in range(len(batch)):
            yield from batch.slice(k, 1).to_pylist()


def _batches(ids: str):
    def run(batches):
        hold(HELD)
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                sizes, token = (np.concatenate(x) for x in zip(*(_tokens(data[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a]) for a, b in chunks(offsets[i : j + 1] - offsets[i], PIECE))))
                kinds, token = _unique(token)
                held = batch.column(2).slice(i, j - i)
                learned = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), sizes)
                times = np.bincount(token, learned, len(kinds)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "batch": [at], "ids": pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.column(0).type)), "held": [held.to_pylist()], "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
                    "blob": [bundled(_steps(kinds), times, token.astype(np.uint32))], "n_kinds": [len(kinds)], "n_tokens": [len(token)],
                })
                at += 1

    return run, f"batch bigint, ids array<{ids}>, held array<boolean>, sizes array<int>, blob binary, n_kinds bigint, n_tokens bigint"


ASKED = "part bigint, batch bigint, blob binary"


def _asking(pieces: list, batch: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int64()), pa.array([batch] * len(pieces), pa.int64()), pa.array([b for _, b in pieces], pa.binary())], ["part", "batch", "blob"])


def _words_asked(parts: int):
    def run(batches):
        for row in _rows(batches):
            kinds, times, _ = unbundled(row["blob"], np.uint64, np.uint32, np.uint32)
            kinds = np.cumsum(kinds, dtype=np.uint64)
            yield _asking([(p, bundled(_steps(kinds[a:b]), times[a:b])) for p, a, b in _pieces(_part(kinds, parts))], row["batch"])

    return run


def _asked(order: int, set_: Setting, low: int, high: int):
    """What each batch asks of the partitions from low to below high in this order."""

    def run(batches):
        for row in _rows(batches):
            own = Batch(row)
            yield _asking(Asked(own, own.level(row, order - 1, set_), order, set_).asking(low, high, set_.parts), row["batch"])

    return run


#: Answers to a batch, the counts of a partition (batch null), the batches that a split history matters to, and the sums of its shares.
ANSWER = "batch bigint, part bigint, blob binary, kinds bigint, total bigint, n array<bigint>, name bigint, share array<double>"


def _answers(part: int, batches: list[int], blobs: list[bytes], total: np.ndarray, names: list[tuple[int, int]] = (), shares: list[tuple[int, list]] = ()) -> pa.Table:
    few = np.bincount(total[(total > 0) & (total <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:].tolist()
    n, m, s = len(batches), len(names), len(shares)
    none = lambda k: [None] * k
    return pa.table({
        "batch": pa.array([*batches, None, *(b for b, _ in names), *none(s)], pa.int64()), "part": pa.array([part] * (n + 1 + m + s), pa.int64()), "blob": pa.array([*blobs, *none(1 + m + s)], pa.binary()),
        "kinds": pa.array([*none(n), int((total > 0).sum()), *none(m + s)], pa.int64()), "total": pa.array([*none(n), int(total.sum()), *none(m + s)], pa.int64()), "n": pa.array([*none(n), few, *none(m + s)], pa.list_(pa.int64())),
        "name": pa.array([*none(n + 1), *(x for _, x in names), *(x for x, _ in shares)], pa.int64()), "share": pa.array([*none(n + 1 + m), *(x for _, x in shares)], pa.list_(pa.float64())),
    })


def _counting(count):
    """count, on a group, in a worker that keeps its free memory for that time only."""

    def run(group: pa.Table) -> pa.Table:
        hold(HELD)
        try:
            return count(group)
        finally:
            release()

    return run


def _count_words(parts: int):
    def run(group: pa.Table) -> pa.Table:
        part, asked = group["part"][0].as_py(), [unbundled(x, np.uint64, np.uint32) for x in group["blob"].to_pylist()]
        found, inverse = _unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in asked]))
        total = np.bincount(inverse, np.concatenate([t for _, t in asked]), len(found)).astype(np.int64)
        number = np.empty(len(found), np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(found), dtype=np.uint64) * np.uint64(parts) + np.uint64(part)  # common words get small ones
        edge = np.cumsum([0, *(len(k) for k, _ in asked)])
        own = [inverse[a:b] for a, b in zip(edge[:-1], edge[1:])]
        return _answers(part, group["batch"].to_pylist(), [bundled(total[x].astype(np.uint64), number[x]) for x in own], total)

    return _counting(run)


def _history_sums(run: np.ndarray, total: np.ndarray, mass: np.ndarray, n: int) -> np.ndarray:
    out, width = np.zeros((n, SUMS)), DISCOUNTED + 2
    out[:, :DISCOUNTED] = np.bincount(run * width + np.minimum(total, DISCOUNTED + 1), minlength=n * width).reshape(n, width)[:, 1 : DISCOUNTED + 1]
    out[:, -2] = np.bincount(run, np.where(total > DISCOUNTED, total, 0), n)
    out[:, -1] = np.bincount(run, np.where(total > 0, mass, 0), n)
    return out


def _count_grams(table: np.ndarray):
    """table: discounts of the order below."""

    def count(group: pa.Table) -> pa.Table:
        batches = group["batch"].to_pylist()
        asked = [unbundled(x, np.uint64, np.uint32, np.uint64, np.uint8, np.int64, np.uint64, np.uint32, np.int64) for x in group["blob"].to_pylist()]
        known, run = _unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked]))
        length, split, base, follower, times, less = (np.concatenate([x[k] for x in asked]) for k in (1, 3, 4, 5, 6, 7))
        of, base = np.repeat(run, length), np.repeat(base, length)
        order, begin, own, _ = _pairs(of.view(np.uint64), follower)
        kind = np.empty(len(order), np.int64)
        kind[order] = _spread(np.diff(begin, append=len(order)))
        one = order[begin]
        total = np.add.reduceat(times[order], begin, dtype=np.int64)
        sums = _history_sums(own.view(np.int64), total, discounted(less[one], table) / base[one], len(known))
        sure = ~sums[:, :DISCOUNTED].any(axis=1)  # nothing is discounted
        seen = total[kind]
        need = (np.logical_or.reduceat(seen == 0, np.cumsum(length, dtype=np.int64) - length) | sure[run]) & (split == 0)
        seen, need = seen.view(np.uint64), need.view(np.uint8)
        edge, at = np.cumsum([0, *(len(x[5]) for x in asked)]), np.cumsum([0, *(len(x[1]) for x in asked)])
        blobs, names, shares = [], [], {}
        for k, x in enumerate(asked):
            own, some = run[at[k] : at[k + 1]], need[at[k] : at[k + 1]]
            blobs.append(bundled(seen[edge[k] : edge[k + 1]], some, sums[own[some.view(bool)]].T.reshape(-1)))
            if len(x[2]):
                names += [(batches[k], int(n)) for n in np.unique(x[2]).view(np.int64)]
                shares |= {int(r): int(n) for r, n in zip(own[np.flatnonzero(x[3])], x[2].view(np.int64))}
        return _answers(group["part"][0].as_py(), batches, blobs, total, names, [(n, sums[r].tolist()) for r, n in shares.items()])

    return _counting(count)


def _scored(order: int, set_: Setting):
    def run(batches):
        for row in _rows(batches):
            own = Batch(row)
            count = own.words(row, set_.model).count
            top = own.level(row, order, set_, last=True)
            base = np.log10((count + 1) / (set_.model.total + set_.model.kinds + 1))
            add = lambda x: np.add.reduceat(x, own.first)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"]), pa.array(own.held), pa.array(own.sizes), pa.array(add((count > 0).astype(np.int64)[own.token])), pa.array(np.full(len(own.sizes), set_.model.total)), pa.array(add(base[own.token])), pa.array(add(np.log10(top.chance)[top.at]))], ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _stats(rows: DataFrame) -> list[int]:
    """Tokens, kinds, and the numbers of kinds seen 1, 2, ... times."""
    found = rows.where("total is not null").agg(F.sum("total"), F.sum("kinds"), *(F.sum(F.col("n")[i]) for i in range(DISCOUNTED + 1))).first()
    return [int(x or 0) for x in found]


def katz_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a Column, true for rows that nothing is learned from; order: words in an n-gram, 1 at least."""
    if order < 1:
        raise ValueError("order must be 1 at least")
    spark = docs.sparkSession
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    kind = dict(few.dtypes)["_id"]
    run, schema = _batches(kind)
    with storage.bucketed(few.mapInArrow(tidy(run), schema), "batch", "lm_batches") as table:
        n_kinds, n_tokens, texts = table.agg(F.sum("n_kinds"), F.sum("n_tokens"), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
        set_ = Setting(int(texts or 0), storage.parts_for(n_kinds or 0, WORDS), storage.parts_for(n_tokens or 0, PAIRS), Unigrams(0, 0, [0] * (DISCOUNTED + 1)))
        answers = [storage.saved(table.select("batch", "blob").mapInArrow(tidy(_words_asked(set_.word_parts)), ASKED).groupBy("part").applyInArrow(_count_words(set_.word_parts), ANSWER), "words", ARROW)]
        total, kinds, *times = _stats(answers[0])
        if total:
            set_.model = Unigrams(total, kinds, times)
        ready = table.select("batch", "ids", "held", "sizes", "blob").join(_listed(answers[0], 1), "batch")
        for k in range(2, order + 1):
            count, edges, found = _count_grams(set_.tables[-1] if set_.tables else set_.model.table), [set_.parts * i // (k - 1) for i in range(k)], None
            for low, high in zip(edges[:-1], edges[1:]):  # longer n-grams take more room, so they are asked for in more turns
                asked = ready.drop("ids").mapInArrow(tidy(_asked(k, set_, low, high)), ASKED)
                answers.append(storage.saved(asked.groupBy("part").applyInArrow(count, ANSWER), f"grams{k}", ARROW))
                found = answers[-1] if found is None else found.unionByName(answers[-1])
            set_.tables.append(discounts(np.array(_stats(found)[2:])))
            share = found.where("share is not null").groupBy("name").agg(F.array(*(F.sum(F.col("share")[i]) for i in range(SUMS))).alias("share"))
            share = found.where("name is not null and share is null").select("batch", "name").distinct().join(share, "name")
            share = share.groupBy("batch").agg(F.collect_list(F.struct("name", "share")).alias(f"shares{k}"))
            ready = ready.join(_listed(found, k), "batch", "left").join(share, "batch", "left")
        scored = ready.mapInArrow(tidy(_scored(order, set_)), f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        scored = storage.saved(scored, "scores", ARROW)
        storage.dropped(*answers)
    return scored.withColumnRenamed("_id", id_col)


def _listed(answers: DataFrame, order: int) -> DataFrame:
    """A row for each batch with all that it is answered in an order."""
    return answers.where("blob is not null").groupBy("batch").agg(F.collect_list(F.struct("part", "blob")).alias(f"answers{order}"))

"""Repeated-passage removal with suffix arrays.

A byte goes if a passage of `length` bytes over it also starts anywhere else in the corpus. A suffix
array of the corpus would have a row for each byte, so texts are first narrowed down without loss: the
least of the `GRAM`-byte hashes in a passage is its anchor, equal passages have equal anchors at the same
place, and a passage whose anchor is nowhere else is unique. The passages of one anchor are neighbours
and make one context of about 280 bytes; a context that occurs twice as a whole is all repeats. Only the
other contexts of repeated anchors are sorted: shards of them get a suffix array by Larsson-Sadakane
refinement (only groups that are not yet sorted are refined, doubling the depth), common prefixes by
Kasai's bound in its permuted form, and an anchor with very many contexts is split over shards whose
sorted passages are then merged by binary search.

Passages are compared byte by byte within a shard. Anchors, whole contexts (with their anchors) and the
passages that shards exchange are compared by 64-bit hashes with fixed salts, so two unlike ones count as
equal with a chance of 2 ** -64 a pair.

Null texts count as empty; a very long text is hashed as a whole; texts under `length` bytes stay whole; repeated rows are repeats of each other
even if they share an id; any columns but id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.textbytes import Sums, chunks, column_bytes, mixed, packed, tidy, unpacked

LENGTH, GRAM = 200, 48
#: Bytes of text that are hashed at once, and bytes of context in a shard.
CHUNK, SHARD = 1_000_000, 600_000
#: Contexts of one anchor that a shard takes; more are dealt over several.
SPLIT = 1_000
#: Passages of split anchors in a merging task.
MERGE = 1_000_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple:
    """(document, first passage, place of the anchor, passages less one, anchor hash, context hash) of each context."""
    gram = min(GRAM, length)
    window = length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none
    sums = Sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = sums.of(at, at + gram)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    long = np.flatnonzero(sizes >= length)
    count = sizes[long] - length + 1
    document = np.repeat(long, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[long], count)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(anchor)) - 1
    lo, more, anchor = start[first], start[last] - start[first], anchor[first]
    context = sums.of(lo, lo + more + length) ^ mixed(((anchor - lo) * 65536 + more).astype(np.uint64))
    return document[first], lo - offsets[document[first]], anchor - lo, more, hashes[anchor].view(np.int64), context.view(np.int64)


def suffix_array(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement. symbols: byte + 1, or 0 at the end of each string; left: how far that end is.

    Ends differ from one another and sort by place, so that the order is total."""
    n, key = len(symbols), np.zeros(len(symbols), np.uint64)
    padded = np.concatenate((symbols, np.zeros(7, symbols.dtype)))
    for j in range(7):
        key <<= np.uint64(9)
        key |= np.where(left > j, padded[j : n + j], 0).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    ended = np.flatnonzero(left[order] < 7)
    order[ended] = order[ended][np.lexsort((order[ended], key[ended]))]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    fresh[ended] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    depth = 7
    while len(slots):
        some = order[slots]
        key = (rank[some].astype(np.uint64) << np.uint64(32)) | rank[some + depth].astype(np.uint64)
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[slots] = some
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[some] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


def common_prefixes(symbols: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the suffix array.

    Kasai's bound, prefix(i) >= prefix(i - 1) - 1, is an equality where the bytes before both suffixes
    agree, so only the other suffixes are compared, eight bytes at a time."""
    n = len(symbols)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    at = np.arange(n)
    known = (at > 0) & (before > 0)
    known[known] = (symbols[at[known] - 1] == symbols[before[known] - 1]) & (symbols[at[known] - 1] > 0)
    some = np.flatnonzero(~known & (before >= 0))
    text = np.concatenate((np.where(symbols > 0, symbols - 1, 0).astype(np.uint8), np.zeros(8, np.uint8)))
    eight = np.zeros(n + 1, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | text[j : n + j + 1].astype(np.uint64)
    most = np.minimum(left[some], left[before[some]])
    found = np.zeros(len(some), np.int64)
    active = np.arange(len(some))
    while len(active):
        here = found[active]
        differ = eight[some[active] + here] ^ eight[before[some[active]] + here]
        same = np.zeros(len(active), np.int64)
        for bits in (32, 16, 8):
            zero = differ >> np.uint64(64 - bits) == 0
            same += np.where(zero, bits // 8, 0)
            differ = np.where(zero, differ << np.uint64(bits), differ)
        same += differ == 0
        found[active] += same
        active = active[(same == 8) & (found[active] < most[active])]
    prefix = np.zeros(n, np.int64)
    prefix[some] = np.minimum(found, most)
    last = np.maximum.accumulate(np.where(known, 0, at))
    return (prefix[last] - (at - last))[order]


def shard_repeats(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with an end after each context, class of equal passages or -1 for one of a kind, start of each context)."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = data.astype(np.int16) + 1
    symbols[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(len(data))
    order = suffix_array(symbols, left)
    equal = common_prefixes(symbols, left, order) >= length
    equal[:1] = False
    twice = equal | np.append(equal[1:], False)
    kind = np.full(len(data), -1, np.int64)
    kind[order] = np.where(twice, np.cumsum(~equal), -1)
    return data, kind, ends - sizes


FOUND = "_k bigint, lo int, hi int, part int, digests binary, keys binary, places binary"


def _shard(length: int, parts: int):
    def run(group: pa.Table) -> pa.Table:
        contexts = group["context"].to_pylist()
        own, split = (np.array(group[c].to_pylist(), bool) for c in ("own", "split"))
        keys, places = (np.array(group[c].to_pylist(), np.int64) for c in ("_k", "pos"))
        data, kind, begin = shard_repeats(contexts, length)
        count = np.fromiter(map(len, contexts), np.int64, len(contexts)) - length + 1
        of = np.repeat(np.arange(len(contexts)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        kinds = kind[begin[of] + step]
        hit = own[of] & (kinds >= 0)
        first = hit & ~np.concatenate(([False], hit[:-1] & (of[1:] == of[:-1])))
        last = hit & ~np.append(hit[1:] & (of[1:] == of[:-1]), False)
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        found = {"_k": keys[of[first]], "lo": places[of[first]] + step[first], "hi": places[of[last]] + step[last] + length}
        blobs: dict[str, list] = {"part": [], "digests": [], "keys": [], "places": []}
        if split.any():
            _, one = np.unique(np.where(kinds >= 0, kinds, -1 - np.arange(len(kinds))), return_index=True)
            one = one[split[of[one]]]
            at = begin[of[one]] + step[one]
            digest = Sums(data).of(at, at + length)
            order = np.argsort(digest)
            one, digest = one[order], digest[order]
            place = np.where(own[of[one]] & (kinds[one] < 0), places[of[one]] + step[one], -1)
            edge = np.searchsorted(digest >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(parts))
            for part in np.flatnonzero(np.diff(edge)):
                a, b = edge[part], edge[part + 1]
                for name, value in (("part", int(part)), ("digests", packed(digest[a:b])), ("keys", packed(keys[of[one[a:b]]])), ("places", packed(place[a:b].astype(np.int32)))):
                    blobs[name].append(value)
        n, m = len(first), len(blobs["part"])
        return pa.table({
            **{c: pa.concat_arrays([pa.array(found[c], k), pa.nulls(m, k)]) for c, k in (("_k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))},
            **{c: pa.concat_arrays([pa.nulls(n, k), pa.array(blobs[c], k)]) for c, k in (("part", pa.int32()), ("digests", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()))},
        })

    return run


def _merge(length: int):
    """Passages of split anchors that another shard has too: each shard's are sought in the sorted passages of all."""

    def run(group: pa.Table) -> pa.Table:
        digests, keys, places = (np.concatenate([unpacked(x, k) for x in group[c].to_pylist()]) for c, k in (("digests", np.uint64), ("keys", np.int64), ("places", np.int32)))
        everywhere = np.sort(digests)
        count = np.searchsorted(everywhere, digests, "right") - np.searchsorted(everywhere, digests, "left")
        hit = (count > 1) & (places >= 0)
        return pa.table({"_k": keys[hit], "lo": pa.array(places[hit], pa.int32()), "hi": pa.array(places[hit] + length, pa.int32())})

    return run


def repeats(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame]]:
    """(_k, lo, hi) byte ranges of keyed rows that are covered by repeated passages, and the tables they rest on."""

    def narrowed(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK):
                doc, lo, skip, more, gram, context = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + doc]), pa.array(lo, pa.int32()), pa.array(skip * 65536 + more, pa.int32()), pa.array(gram), pa.array(context)], ["_k", "pos", "pack", "h", "g"])

    spots = storage.saved(rows.select("_k", "_text").mapInArrow(tidy(narrowed), "_k bigint, pos int, pack int, h bigint, g bigint"), "anchors")
    often = storage.saved(spots.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")  # written, so that Spark can split a hot anchor's join
    again = storage.saved(spots.join(often, "h", "left_semi"), "again")
    kinds = again.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k", "pos", "pack")).alias("at"))
    kinds = storage.saved(kinds, "contexts")
    storage.dropped(spots, often)
    whole = again.join(kinds.where("n > 1").select("h", "g"), ["h", "g"], "left_semi")
    whole = whole.select("_k", F.col("pos").alias("lo"), F.expr(f"pos + pack % 65536 + {length}").cast("int").alias("hi"))
    per = storage.saved(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("single")).where("m > 1 and single > 0"), "anchors")
    edge = kinds.join(per, "h").select("h", "m", "at.*", (F.col("n") == 1).alias("own"), (F.col("m") > SPLIT).alias("split"), F.expr(f"cast(if(m > {SPLIT}, pmod(g, ceil(m / {SPLIT})), 0) as int)").alias("sub"))
    edge = storage.saved(edge.select("*", F.expr(f"pack % 65536 + {length}").alias("size")), "edges")
    volume = edge.agg(F.sum("size")).first()[0] or 0
    shards = storage.parts_for(volume, SHARD)
    listed = edge.withColumn("shard", F.expr(f"cast(pmod(xxhash64(h, sub), {shards}) as int)")).groupBy("_k").agg(F.collect_list(F.struct("pos", "size", "own", "split", "shard")).alias("each"))
    cut = rows.join(listed, "_k").select("_k", F.col("_text").cast("binary").alias("bin"), "each")
    cut = cut.select("_k", F.explode(F.expr("transform(each, x -> struct(x.pos as pos, x.own as own, x.split as split, x.shard as shard, substring(bin, x.pos + 1, x.size) as context))")).alias("x")).select("_k", "x.*")
    asked = edge.where("split").agg(F.sum(F.expr("pack % 65536 + 1"))).first()[0] or 0
    found = storage.saved(cut.groupBy("shard").applyInArrow(_shard(length, storage.parts_for(asked, MERGE)), FOUND), "sorted")
    storage.dropped(per, edge)
    tables, parts = [again, kinds, found], [whole, found.where("part is null").select("_k", "lo", "hi")]
    if asked:
        parts.append(found.where("part is not null").groupBy("part").applyInArrow(_merge(length), "_k bigint, lo int, hi int"))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    return spans, tables


def _kept(batches):
    for batch in batches:
        keys = batch.column("_k")
        data, offsets = column_bytes(batch.column("_text"))
        out = []
        for i, ranges in enumerate(batch.column("each").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            runs: list[list[int]] = []
            for r in sorted((x["lo"], x["hi"]) for x in ranges or ()):
                if runs and r[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], r[1])
                else:
                    runs.append(list(r))
            edges = [0, *(x for r in runs for x in r), len(text)]
            out.append((b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), [{"start": a, "end": b} for a, b in runs]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets)), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], kind)], ["_k", "n_bytes", "kept", "spans"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id, n_bytes, kept (the remaining bytes), spans (removed ranges, maximal, in order).

    Spans that touch are one span. See the module for nulls, short texts and repeated rows."""
    if length < 8 or length > 30_000:
        raise ValueError("length must be from 8 to 30000")
    rows, own = storage.keyed(docs, id_col, text_col)
    spans, tables = repeats(rows, length)
    listed = storage.saved(spans.groupBy("_k").agg(F.collect_list(F.struct("lo", "hi")).alias("each")), "spans")
    storage.dropped(*tables)
    joined = rows.join(listed, "_k", "left")
    if not own:
        return joined.select("_k", "_text", "each").mapInArrow(tidy(_kept), "_k bigint, n_bytes bigint, kept binary, spans array<struct<start:int,end:int>>").withColumnRenamed("_k", id_col).withColumn(id_col, F.col(id_col).cast(dict(docs.dtypes)[id_col]))
    made = joined.select("_k", "_text", "each").mapInArrow(tidy(_kept), "_k bigint, n_bytes bigint, kept binary, spans array<struct<start:int,end:int>>")
    return made.join(rows.select("_k", F.col("_id").alias(id_col)), "_k").drop("_k")

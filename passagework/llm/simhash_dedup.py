"""SimHash near-duplicates, found with the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most `radius`. The bits are grouped into parts,
correlated bits together, and part i gets a threshold t_i >= -1 with the sum of (t_i + 1) equal to
radius + 1: two fingerprints within the radius are then within t_i on some part i, so probing every part
with all values within its threshold misses nothing. The number of parts and the thresholds come from
dynamic programming on candidate counts, which are estimated on a bounded sample of distinct
fingerprints; the sample steers cost only, never the result.

Equal fingerprints are one node. In a bucket, links are verified by exact distance and leave it as a
spanning forest, not as pairs, so a dense group of n costs n edges; a bucket with over BLOCK members is
dealt out as pairs of blocks.

Null texts and texts without words have fingerprint zero and link like any other; a null id counts for
no component_id (null if no member has an id); repeated rows share a component; columns other than id
and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.components import components
from passagework.llm.textbytes import MAX, bundled, chunks, column_bytes, lowered, mixed, spaces, starts, tidy, unbundled, words

CHUNK, SAMPLE, BLOCK = 2_000_000, 20_000, 8_192
#: Bands of near_duplicates, and least hashes in each; bytes that go to a Python worker at once there.
BANDS, ROWS = 16, 4
#: Rounds with a leader there; texts and bytes of a block of those left, and places of shingles counted at once.
TURNS, TEXTS, WEIGHT, PLACES = 2, 512, 8_000_000, 2_000_000
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Cost of a probe row and of a compared pair, in ns: they weigh the plan only.
ROW_NS, PAIR_NS = 10_000, 4
_lanes = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each shingle, n + 1 offsets): words of the lower-cased text joined by one space; fewer words make one shingle."""
    low = lowered(data)
    start, end, of = words(low, offsets)
    count = np.diff(of)
    keep = ~spaces(low)
    later = np.ones(len(start), bool)
    later[of[:-1][count > 0]] = False
    gaps = start[later] - 1
    keep[gaps] = True
    low[gaps] = 32
    place = np.cumsum(keep) - 1
    joined = low[keep].tobytes()
    number = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    offset = np.concatenate(([0], np.cumsum(number)))
    doc, step = starts(low, offset)
    first = of[doc] + step
    last = first + np.minimum(size, count[doc]) - 1
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(place[start[first]].tolist(), (place[end[last] - 1] + 1).tolist())]
    return np.array(found, np.uint64), offset


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit fingerprint per document: the bits that over half of its shingles have."""
    return fingerprints_of(*shingle_hashes(data, offsets, size))


def fingerprints_of(hashes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    count = np.diff(offset)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    blocks = -(-count[some] // 255)
    at = np.concatenate(([0], np.cumsum(blocks)))
    doc, step = starts(hashes, at)
    begin = offset[some][doc] + 255 * step
    eight = hashes.view(np.uint8).reshape(-1, 8)
    for c in range(8):
        lanes = np.add.reduceat(_lanes[eight[:, c]], begin).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), at[:-1], axis=0)
        for j in range(8):
            out[some] |= (2 * ones[:, j] > count[some]).astype(np.uint64) << np.uint64(8 * c + j)
    return out


def parts_of(bits: np.ndarray, number: int) -> list[list[int]]:
    """The 64 bits in parts of almost equal size, each filled with the bit most correlated with those it has."""
    spread = bits.std(axis=0) if len(bits) else np.zeros(64)
    near = np.abs(np.corrcoef(bits + 1e-9 * np.arange(64), rowvar=False)) if len(bits) > 2 else np.zeros((64, 64))
    near = np.where((spread > 0)[:, None] & (spread > 0), np.nan_to_num(near), 0)
    np.fill_diagonal(near, 0)
    free, parts = set(range(64)), []
    for k in range(number):
        size = 64 // number + (k < 64 % number)
        part = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(sorted(free), key=lambda b: near[b, part].sum()))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def plan(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with the least estimated cost for `total` distinct fingerprints; parts with threshold -1 are left out."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    rng = np.random.default_rng(7)
    differ = sample[rng.integers(0, max(1, len(sample)), 200_000)] ^ sample[rng.integers(0, max(1, len(sample)), 200_000)] if len(sample) else np.zeros(1, np.uint64)
    best: tuple[float, list] = (float("inf"), [])
    for number in range(1, radius + 2):
        parts, costs = parts_of(bits, number), []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            apart, width, row = np.bitwise_count(differ & mask), len(part), [0.0]
            for t in range(min(radius, width - 1) + 1):
                probes = sum(comb(width, j) for j in range(t + 1))
                share = max(float((apart <= t).mean()), probes / 2.0**width)
                row.append(total * float(probes) * ROW_NS + total * float(total) * share * PAIR_NS)
            costs.append(row)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for have, (cost, chosen) in reach.items():
                for more, extra in enumerate(row):
                    key = min(have + more, radius + 1)
                    if key not in new or cost + extra < new[key][0]:
                        new[key] = (cost + extra, [*chosen, more - 1])
            reach = new
        if radius + 1 in reach and reach[radius + 1][0] < best[0]:
            best = (reach[radius + 1][0], [(p, t) for p, t in zip(parts, reach[radius + 1][1]) if t >= 0])
    return best[1]


def probes(chosen: list[tuple[list[int], int]]) -> list[tuple[int, int, int]]:
    """(part, mask, change) of all values within each part's threshold, as signed longs; change 0 is the value itself."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(i, signed(sum(1 << b for b in part)), signed(sum(1 << b for b in flips))) for i, (part, t) in enumerate(chosen) for j in range(t + 1) for flips in combinations(part, j)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for nodes 0..n-1 and links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined(values: np.ndarray, centres: np.ndarray, radius: int, label: np.ndarray) -> np.ndarray:
    """Labels (least members) of components, after the links of the centres are added to those that labels state."""
    for c in centres:
        met = label[np.bitwise_count(values ^ values[c]) <= radius]
        if met.min() != met.max():
            label[np.isin(label, np.unique(met))] = met.min()
    return label


def forest(values: np.ndarray, centre: np.ndarray, group: np.ndarray, radius: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links within each group (runs of equal numbers), one at most for each row; one end of a link is a centre.

    side: 0, or which of two blocks (1, 2) a row is of. What links within a block is joined elsewhere, so a
    pair of blocks yields only edges between components of the blocks."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    which = np.repeat(np.arange(len(first)), size)
    small = np.flatnonzero(centre & (size[which] <= 64) & (size[which] > 1))
    for k in range(0, len(small), 20_000):
        c = small[k : k + 20_000]
        count = size[which[c]]
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[which[c]], count)
        c = np.repeat(c, count)
        hit = np.bitwise_count(values[c] ^ values[other]) <= radius
        left.append(c[hit])
        right.append(other[hit])
    for g in np.flatnonzero(size > 64):
        own = values[first[g] : first[g] + size[g]]
        centres, half = np.flatnonzero(centre[first[g] : first[g] + size[g]]), side[first[g] : first[g] + size[g]]
        label = np.arange(size[g])
        for k in (1, 2) if half.any() else ():
            part = np.flatnonzero(half == k)
            if len(part):
                label[part] = part[_joined(own[part], np.searchsorted(part, centres[half[centres] == k]), radius, np.arange(len(part)))]
        within = label.copy()
        label = _joined(own, centres, radius, label)
        apart = np.flatnonzero((within == np.arange(size[g])) & (label != within))
        left.append(first[g] + apart)
        right.append(first[g] + label[apart])
    left, right = np.concatenate(left), np.concatenate(right)
    root = _roots(len(values), left, right)
    apart = np.flatnonzero(root != np.arange(len(values)))
    return values[apart], values[root[apart]]


def whole_groups(batches):
    """Tables of the rows of batches that are sorted by group, each with all rows of its groups."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch]).combine_chunks()
        group = rows["group"].to_numpy()
        whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if whole:
            yield rows.slice(0, whole).combine_chunks()
        kept = rows.slice(whole)
    if kept is not None and len(kept):
        yield kept.combine_chunks()


def _buckets(radius: int):
    def run(batches):
        for rows in whole_groups(batches):
            a, b = forest(rows["fp"].to_numpy().view(np.uint64), rows["centre"].to_numpy(zero_copy_only=False), rows["group"].to_numpy(), radius, rows["side"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def dealt(rows: DataFrame, more: str, by: str) -> DataFrame:
    """rows with group and side: those of a bucket (column `more`) in one group, or, over `blocks` 1, in a group for each pair of its blocks.

    blocks: a column of rows; by: the column by which rows are dealt out to blocks. side: 0 within a block, else which block of the pair (1, 2)."""
    rows = rows.withColumn("own", F.expr(f"cast(pmod(xxhash64({by}, 1), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    group = F.expr(f"if(blocks = 1, {more}, xxhash64({more}, least(own, other), greatest(own, other)))")
    return rows.withColumn("group", group).withColumn("side", F.expr("if(own = other, 0, if(own < other, 1, 2))"))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges whose components are those of all distinct fingerprints (column fp) within the radius."""
    total = max(1_000, nodes.count())
    few = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    tried = probes(plan(few, total, radius))
    part, mask, change = (F.lit(list(column)) for column in zip(*tried))
    rows = nodes.select("fp", F.inline(F.arrays_zip(part.alias("part"), mask.alias("mask"), change.alias("change"))).alias("part", "mask", "change"))
    rows = rows.select("fp", (F.col("change") == 0).alias("centre"), F.expr("xxhash64(part, (fp & mask) ^ change)").alias("group"))
    heavy = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK}")
    rows = rows.join(heavy, "group", "left").withColumn("blocks", F.expr(f"cast(coalesce(ceil(n / {BLOCK}), 1) as int)"))
    rows = dealt(rows.withColumnRenamed("group", "bucket"), "bucket", "fp").select("fp", "centre", "group", "side")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_buckets(radius)), "a bigint, b bigint")


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size) for i, j in chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["_id", "fp"])

    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return few.mapInArrow(tidy(run), f"_id {dict(few.dtypes)['_id']}, fp bigint")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fp (long), component_id (least id among all that links reach)."""
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    table = storage.saved(fingerprint_table(docs, id_col, text_col, size), "fingerprints")
    nodes = storage.saved(table.groupBy("fp").agg(F.min("_id").alias("least")), "nodes")
    edges = storage.saved(links(nodes.select("fp"), radius), "links")
    joined = components(edges)
    rooted = nodes.join(joined.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(named, "root").select("fp", "component_id")
    return table.join(rooted, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def _sketches(size: int):
    """Fingerprint and bands of each text: band i is a hash of ROWS least hashes of its distinct shingles, under mixes of its own."""
    salts = np.random.default_rng(20250117).integers(0, 1 << 64, (BANDS * ROWS, 2), dtype=np.uint64)
    salts[:, 0] |= np.uint64(1)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("_text"))
            for i, j in chunks(offsets, CHUNK // 2):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, at = shingle_hashes(text, own, size)
                least = np.full((BANDS * ROWS, j - i), np.uint64(MAX))
                some = np.flatnonzero(np.diff(at))
                for k, (times, plus) in enumerate(salts):
                    if len(some):
                        least[k, some] = np.minimum.reduceat((hashes ^ plus) * times, at[:-1][some])
                bands = np.zeros((BANDS, j - i), np.uint64)
                for k in range(BANDS * ROWS):
                    bands[k // ROWS] = mixed(bands[k // ROWS] + least[k] + np.uint64(k // ROWS))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(bands.T).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), pa.array(fingerprints_of(hashes, at).view(np.int64)), listed], ["k", "fp", "bands"])

    return run, "k bigint, fp bigint, bands array<bigint>"


def _sets(size: int):
    """The distinct shingles of each text, by 48 bits of their hashes."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("_text"))
            for i, j in chunks(offsets, CHUNK):
                hashes, at = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                found = [bundled(np.diff(np.unique(hashes[a:b] >> np.uint64(16)), prepend=np.uint64(0))) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(i, j - i), pa.array(found, pa.binary())], ["k", "shingles"])

    return run, "k bigint, shingles binary"


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            own, first, hit, last = batch.column("shingles"), batch.column("leading"), [], (None, None)
            for a, b in zip(own, first):
                a, b = np.cumsum(unbundled(a.as_py(), np.uint64)[0], dtype=np.uint64), b.as_py()
                if last[0] != b:
                    last = (b, np.cumsum(unbundled(b, np.uint64)[0], dtype=np.uint64))
                b = last[1]
                least = min(len(a), len(b))
                shared = len(np.intersect1d(a, b, True)) if least >= similarity * max(len(a), len(b)) else 0
                hit.append(not len(a) + len(b) or shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("leader"), pa.array(hit, pa.bool_())], ["k", "leader", "alike"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (k, leader) of similar texts, written."""
    both = pairs.join(sets, "k").join(sets.select(F.col("k").alias("leader"), F.col("shingles").alias("leading")), "leader")
    found = both.select("k", "leader", "shingles", "leading").mapInArrow(tidy(_alike(similarity)), "k bigint, leader bigint, alike boolean")
    return storage.saved(found.where("alike").select("k", "leader"), "similar", ARROW)


def _grown(star: DataFrame | None, found: DataFrame) -> DataFrame:
    """(u, v) as components() gives it for the links that star stands for and the similar pairs found since; star goes."""
    edges = found.select(F.col("k").alias("a"), F.col("leader").alias("b"))
    if star is None:
        return components(edges)
    now = components(edges.unionByName(star.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    storage.dropped(star)
    return now


def _rooted(rows: DataFrame, star: DataFrame) -> DataFrame:
    """rows with root, the least key that similar pairs lead to."""
    return rows.join(star.select(F.col("u").alias("k"), F.col("v").alias("root")), "k", "left").withColumn("root", F.coalesce("root", "k"))


def similar_forest(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that join what no chain of pairs and no common root joins yet; sides as in forest()."""
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(sets)), size)
    _, item, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    rows = of[np.argsort(item, kind="stable")]  # of each item, the sets that have it
    at = np.concatenate(([0], np.cumsum(count)))
    label, out = np.unique(root, return_inverse=True)[1], []
    for i in np.flatnonzero(side < 2):
        open_ = (side == (2 if side[i] else 0)) & (label != label[i])
        if not side[i]:
            open_[:i] = False
        if not open_.any():
            continue
        own, shared = item[begin[i] : begin[i + 1]], np.zeros(len(sets), np.int64)
        number = np.concatenate(([0], np.cumsum(count[own])))
        for a, b in chunks(number, PLACES):
            few = count[own[a:b]]
            place = np.arange(number[b] - number[a]) - np.repeat(number[a:b] - number[a], few) + np.repeat(at[own[a:b]], few)
            shared += np.bincount(rows[place], minlength=len(sets))
        for j in np.flatnonzero(open_ & (shared >= similarity * (size[i] + size - shared))):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def _forests(similarity: float):
    def run(batches):
        for rows in whole_groups(batches):
            k, root, side, group = (rows[c].to_numpy() for c in ("k", "root", "side", "group"))
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            pairs = []
            for a, b in zip(first[:-1], first[1:]):
                if (root[a:b] != root[a]).any():
                    sets = [np.cumsum(unbundled(x.as_py(), np.uint64)[0], dtype=np.uint64) for x in rows["shingles"].slice(a, b - a)]
                    pairs += [(k[a + i], k[a + j]) for i, j in similar_forest(sets, root[a:b], side[a:b], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in pairs], pa.int64()), pa.array([min(x) for x in pairs], pa.int64())], ["k", "leader"])

    return run


def _rest(label: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs (k, leader) that connect what is similar in each bucket of label (b, k, root), a spanning forest of each bucket's links, written.

    Buckets are compared whole; one of over TEXTS texts or WEIGHT bytes is dealt out as pairs of blocks."""
    listed = label.join(sets.select("k", F.octet_length("shingles").alias("bytes")), "k")
    heavy = listed.groupBy("b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum("bytes") / WEIGHT), F.lit(1)).cast("int").alias("blocks"))
    heavy = storage.saved(heavy, "heavy")
    placed = storage.saved(dealt(label.join(heavy, "b"), "b", "k").select("k", "root", "group", "side"), "dealt")
    rows = placed.join(sets, "k").select("k", "root", "group", "side", "shingles")
    rows = rows.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_forests(similarity)), "k bigint, leader bigint")
    found = storage.saved(rows, "similar", ARROW)
    storage.dropped(heavy, placed)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, radius: int = 6, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each group one stays, that of the least key, all its columns with it.

    Two texts are similar if at least `similarity` of the distinct shingles of both are shared; a group is all
    that similar pairs connect. Candidates come from two places, and all are verified. First, fingerprints
    within the radius (generalised pigeonhole): each text is compared with the least of its component. A
    64-bit fingerprint cannot tell texts of similarity 0.8, which are 10 bits apart and up to 20, from
    unlike ones without comparing a share of all pairs, so second, texts that agree in one of BANDS bands of
    ROWS least hashes: in a bucket the text with most company in its buckets leads, as the original of many
    near copies does, and those not yet connected to it are compared with it, TURNS times. Buckets in which
    several groups are left are then compared whole: shared shingles of all their texts are counted in
    blocks, and only a spanning forest of the similar pairs leaves them. So a dense group of texts that are
    almost, but not quite, similar costs a count for each pair that agrees in a band, but no row. A pair of
    similarity 0.8 agrees in no band with a chance of 0.0002 (0.9: 1e-7), and one that agrees is found.

    Null texts are empty; texts without words are similar to each other; a text of fewer words than `size` is
    one shingle. Keys are ids, or row numbers where ids repeat or are null. An empty table stays empty."""
    rows, own = storage.keyed(docs, id_col, text_col)
    if own:  # number whole rows
        whole = storage.saved(docs.withColumn("_row", F.monotonically_increasing_id()), "whole")
        rows = whole.select(F.col("_row").alias("_k"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select(F.col("_k").alias("k"), F.coalesce("_text", F.lit("")).alias("_text"))
    first = rows.groupBy(F.xxhash64("_text").alias("a"), F.crc32(F.col("_text").cast("binary")).alias("b"), F.octet_length("_text").alias("c")).agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    first = storage.saved(first, "first")  # of equal texts
    some = rows if first.where("n > 1").limit(1).count() == 0 else rows.join(first.select("k"), "k", "left_semi")
    run, schema = _sketches(size)
    texts = storage.saved(some.mapInArrow(tidy(run), schema), "sketches")
    near = storage.saved(links(texts.select("fp").distinct(), radius), "links")
    least = texts.select("k", "fp").join(components(near).select(F.col("u").alias("fp"), F.col("v").alias("at")), "fp", "left").select("k", F.coalesce("at", "fp").alias("at"))
    near = storage.saved(_starred(least.select("k", F.col("at").alias("b"))), "near")
    listed = texts.select("k", F.explode("bands").alias("b"))
    often = storage.saved(listed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    live = storage.saved(listed.join(often, "b"), "buckets")
    weight = live.groupBy("k").agg(F.sum("n").alias("w"))
    live = storage.saved(live.drop("n").join(weight, "k"), "buckets")
    asked = live.select("k").unionByName(near.select("k")).unionByName(near.select(F.col("leader").alias("k"))).distinct()
    run, schema = _sets(size)
    sets = storage.saved(some.join(asked, "k", "left_semi").mapInArrow(tidy(run), schema), "sets")
    found = _similar(near, sets, similarity)
    star, tables = _grown(None, found), [first, texts, near, sets, found]
    live = storage.saved(_rooted(live, star), "labels")
    for _ in range(TURNS):
        if not live.limit(1).count():
            break
        place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("w"), "k"))
        heads = live.withColumn("place", place).where("place = 1").select("b", F.col("k").alias("leader"), F.col("w").alias("most"), F.col("root").alias("to"))
        heads = storage.saved(heads, "heads")
        pairs = live.join(heads, "b").where("(w < most or w = most and k > leader) and root <> to").select("k", "leader").distinct()
        found = _similar(pairs, sets, similarity)
        star = _grown(star, found)
        label = storage.saved(_rooted(live.drop("root"), star).join(heads.select("b", F.col("leader").alias("k")), ["b", "k"], "left_anti"), "labels")
        several = storage.saved(label.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("b"), "several")
        tables += [heads, found, live, several]
        live = storage.saved(label.join(several, "b"), "buckets")
        storage.dropped(label)
    if live.limit(1).count():
        found = _rest(live, sets, similarity)
        tables.append(found)
        star = _grown(star, found)
    out = _rooted(some.select("k"), star).where("k = root").select("k")
    out = storage.saved(out, "stay")
    tables += [live, star]
    storage.dropped(*tables)
    if own:
        return whole.join(out.select(F.col("k").alias("_row")), "_row", "left_semi").drop("_row")
    return docs.join(out.select(F.col("k").alias(id_col)), id_col, "left_semi").select(docs.columns)


def _starred(rows: DataFrame) -> DataFrame:
    """(k, leader): each key but the least of its b, with that least one."""
    least = storage.saved(rows.groupBy("b").agg(F.min("k").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("b", "leader"), "least")
    return rows.join(least, "b").where("k > leader").select("k", "leader")

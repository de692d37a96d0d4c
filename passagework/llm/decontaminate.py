"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact verification.

An item has n words and T = n - 4 five-word shingles (fewer than five words: one shingle, the whole
sequence). A window of a document has as many words as the item (or all words of a shorter document).
Similarity is that of weighted shingle sets, weights being occurrences: the sum of the lesser weights over
the sum of the greater. At `similarity` s the shared weight is at least s / (1 + s) of both weights
together, so a window needs that many places whose shingle the item has. A window that does not begin at
such a place can move to the next one without loss, so only windows that begin there, and a document's
last, are fingerprinted.

Fingerprints of 64 bits are compared through BLOCKS blocks of bits, each within one bit: two
fingerprints at most 2 * BLOCKS - 1 apart agree so in one block, so no pair within the radius is lost.
Candidates are verified exactly. The plan has DataFrame functions only.

Null or empty documents and items match nothing; null ids are allowed; equal rows get equal results; equal
items are all reported; other columns are ignored; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage

SHINGLE, SIMILARITY, BLOCKS = 5, 0.8, 12
RADIUS = 2 * BLOCKS - 1
#: Shingles of items up to which they are broadcast; beyond, the join is shuffled.
BROADCAST = 500_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, CAPITALS, SMALL), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def shingles(name: str, size: str) -> Column:
    """Hashes of the runs of `size` words in the array column `name`, in order; none if it has fewer words."""
    return F.expr(f"if(size({name}) < {size} or {size} < 1, cast(array() as array<bigint>), transform(sequence(0, size({name}) - {size}), i -> xxhash64(slice({name}, i + 1, {size}))))")


def fingerprint(name: str) -> Column:
    """Bits that over half of the hashes in the array column have."""
    return F.expr(f"aggregate(sequence(0, 63), 0L, (found, b) -> found | if(2 * aggregate({name}, 0L, (n, x) -> n + (shiftright(x, b) & 1)) > size({name}), shiftleft(1L, b), 0L))")


def _edges() -> list[tuple[int, int]]:
    return [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS - 64 * i // BLOCKS) for i in range(BLOCKS)]


def blocks(fp: str, probe: bool) -> Column:
    """Array of (block, value); with probe, also all values one bit away."""
    each = []
    for i, (at, width) in enumerate(_edges()):
        value = f"(shiftright({fp}, {at}) & {(1 << width) - 1})"
        each += [f"struct({i} as block, {value} as value)"]
        if probe:
            each += [f"struct({i} as block, {value} ^ {1 << b} as value)" for b in range(width)]
    return F.expr(f"array({', '.join(each)})")


def leaks(rows: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(_k, item, start, n, similarity): for each keyed row and item, its best window of at least this similarity."""
    share = similarity / (1 + similarity)
    asked = items.select("item", words(F.col("_text")).alias("w")).where("size(w) > 0").select("item", F.expr("size(w)").alias("n"), F.expr(f"least(size(w), {SHINGLE})").alias("size"), "w")
    asked = storage.saved(asked.withColumn("s", shingles("w", "size")).select("item", "n", "size", "s", fingerprint("s").alias("fp")), "items")
    shape = asked.agg(F.sum(F.size("s")), F.collect_set("size")).first()
    total, sizes = shape[0] or 0, sorted(shape[1] or [SHINGLE])
    weights = asked.select("item", "n", "size", F.size("s").alias("t"), F.explode("s").alias("h")).groupBy("item", "n", "size", "t", "h").agg(F.count(F.lit(1)).alias("weight"))
    kinds = weights.select("size", "h").distinct()
    near = F.broadcast(kinds) if total <= BROADCAST else kinds
    worded = rows.select("_k", words(F.col("_text")).alias("w"))
    seen = None
    for size in sizes:
        each = worded.select("_k", F.size("w").alias("m"), F.lit(size).alias("size"), F.posexplode(shingles("w", str(size))).alias("pos", "h")).join(near, ["size", "h"], "left_semi")
        seen = each if seen is None else seen.unionByName(each)
    seen = storage.saved(seen, "hits")
    hits = seen.join(F.broadcast(weights) if total <= BROADCAST else weights, ["size", "h"])
    have = F.expr("least(t, m - size + 1)")
    listed = hits.groupBy("_k", "m", "item", "n", "size", "t").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    listed = listed.withColumn("need", F.ceil(share * (F.col("t") + have) - 1e-9).cast("int")).where("size(p) >= need")
    last = "greatest(m - n, 0)"
    begin = F.expr(f"array_distinct(filter(transform(sequence(0, size(p) - need), i -> if(p[i] <= {last}, if(p[i + need - 1] - p[i] < t, p[i], -1), {last})), x -> x >= 0 and (x < {last} or size(filter(p, y -> y >= {last})) >= need)))")
    begin = F.array_union(begin, F.expr(f"if(size(filter(p, y -> y >= {last})) >= need, array({last}), cast(array() as array<int>))"))
    spots = storage.saved(listed.select("_k", "n", "size", "t", F.explode(begin).alias("start")).distinct(), "windows")
    window = rows.join(spots, "_k").select("_k", "n", "size", "start", "t", words(F.col("_text")).alias("w"))
    window = window.select("_k", "n", "start", "size", F.expr("slice(w, start + 1, n)").alias("w")).withColumn("s", shingles("w", "size")).select("_k", "n", "start", "s", fingerprint("s").alias("fp"))
    window = storage.saved(window, "fingerprints")
    asking = window.select("_k", "n", "start", F.col("fp").alias("own"), F.inline(blocks("fp", False)).alias("block", "value"))
    answer = asked.select("item", "n", "fp", F.inline(blocks("fp", True)).alias("block", "value"))
    pairs = asking.join(F.broadcast(answer) if total <= BROADCAST else answer, ["n", "block", "value"]).where(f"bit_count(own ^ fp) <= {RADIUS}").select("_k", "n", "start", "item").distinct()
    of_window = window.select("_k", "n", "start", F.size("s").alias("own_t"), F.explode("s").alias("h")).groupBy("_k", "n", "start", "own_t", "h").agg(F.count(F.lit(1)).alias("own_weight"))
    both = pairs.join(of_window, ["_k", "n", "start"]).join(weights.select("item", "t", "h", "weight"), ["item", "h"])
    alike = both.groupBy("_k", "item", "start", "n", "own_t", "t").agg(F.sum(F.least("weight", "own_weight")).alias("shared")).withColumn("similarity", F.col("shared") / (F.col("t") + F.col("own_t") - F.col("shared")))
    return alike.where(F.col("similarity") >= similarity).groupBy("_k", "item", "n").agg(F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")).select("_k", "item", "best.start", "n", "best.similarity")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, contaminated, matches (array of item, first word, words, similarity; by item)."""
    rows, _ = storage.keyed(docs, id_col, text_col)
    few = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("_text"))
    found = leaks(rows, few, similarity).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("item", "start", "n", "similarity"))).alias("matches"))
    joined = rows.select("_k", "_id").join(found, "_k", "left")
    return joined.select(F.col("_id").alias(id_col), F.col("matches").isNotNull().alias("contaminated"), "matches")

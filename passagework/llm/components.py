"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for each node u but the least of its component, v being that least; edges: (a, b), loops and repeats allowed.

    Each round hangs a node's larger neighbours on its least one, then its smaller ones; a hub costs a
    grouped minimum and a join on it, never a list of its neighbours. The minima are written before they
    are joined, so that both sides of the join are plain shuffles and Spark can split a hub's. Rounds grow
    with the logarithm of the graph's size; each is written to the shared folder."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = storage.saved(now, "edges")
    mark, held = _mark(now), [now]
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = storage.saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = storage.saved(large, "large")
        held.append(least)
        least = storage.saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = storage.saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        storage.dropped(large, least, *held)
        held, before = [now], mark
        mark = _mark(now)
        if mark == before:
            break
    return now

"""Measures: nearest-rank quantiles, error rates, bag matches, histograms, samples, reports and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q_<percent>): the value at place min(int(share * n), n - 1) of the sorted values, by a window instead of a list of a group's values."""
    order = Window.partitionBy(*by).orderBy(value)
    known = rows.where(F.col(value).isNotNull())
    placed = known.withColumn("_r", F.row_number().over(order) - 1).join(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by) if by else known
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1)
    return placed.groupBy(*by).agg(F.first("_n").alias("n"), *(F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(f"q_{round(100 * p)}") for p in shares))


def bag_matches(wanted: DataFrame, found: DataFrame, by: str, value: str) -> DataFrame:
    """(by, matched, total): each found value serves one wanted value."""
    w = wanted.groupBy(by, value).agg(F.count(F.lit(1)).alias("w"))
    f = found.groupBy(by, value).agg(F.count(F.lit(1)).alias("f"))
    return w.join(f, [by, value], "left").groupBy(by).agg(F.sum(F.least("w", F.coalesce("f", F.lit(0)))).alias("matched"), F.sum("w").alias("total"))


def weighted_mean(value: Column, weight: Column) -> Column:
    known = value.isNotNull()
    return F.sum(F.when(known, value * weight)) / F.nullif(F.sum(F.when(known, weight)), F.lit(0))


def round_robin(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first n rows when the k-th of every stratum is taken in turn, strata in order."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("turn", k).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def units(amount: Column) -> Column:
    """Rupees in crore, lakh or whole."""
    return F.when(amount >= 1e7, F.concat(F.format_string("%.2f", amount / 1e7), F.lit(" cr"))).when(amount >= 1e5, F.concat(F.format_string("%.2f", amount / 1e5), F.lit(" L"))).otherwise(F.format_string("%.0f", amount))


def deduplicated(rows: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """(key, at): occurrences that are handled when one of a key is remembered for `ttl` seconds and a duplicate does not renew it.

    A fold over a key's times: what is kept depends on the last one kept, which no window frame expresses."""
    times = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.unix_micros(at))).alias("t"))
    kept = F.expr(f"aggregate(t, cast(array() as array<bigint>), (a, x) -> if(size(a) = 0 or x - element_at(a, -1) >= {ttl} * 1000000L, array_append(a, x), a))")
    return times.select(key, F.explode(kept).alias("us")).select(key, F.timestamp_micros("us").alias(at))

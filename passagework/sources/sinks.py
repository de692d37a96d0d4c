"""Writers, and the checks that a write must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.chunking import duplicate_ids


def checked_unique(rows: DataFrame, id_col: str) -> DataFrame:
    """rows, if no id occurs twice; else ValueError with the commonest duplicates."""
    twice = duplicate_ids(rows, id_col).orderBy(F.col("n").desc(), id_col).limit(10).collect()
    if twice:
        raise ValueError("duplicate ids: " + ", ".join(f"{r[0]} x {r[1]}" for r in twice))
    return rows


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_curve(rows: DataFrame, path: str) -> None:
    rows.select("design", "threshold", "coverage", "wrong_rate", "refusal_rate").write.mode("overwrite").csv(path, header=True)


def write_vectors(rows: DataFrame, path: str) -> None:
    """(id, embedding) as Parquet."""
    rows.select("id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def write_texts(rows: DataFrame, path: str) -> None:
    """A text per page and method, in folders of these."""
    rows.select("method", "page", "text").write.mode("overwrite").partitionBy("method", "page").text(path)


def write_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """Summary rows and detail rows side by side; the detail stays distributed."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/detail")


def within_budget(candidates: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """(key, order): the first candidate within the budget, else the smallest."""
    fits = F.col(size) <= budget
    return candidates.groupBy(key).agg(F.coalesce(F.min(F.when(fits, F.col(order))), F.min_by(order, F.struct(size, order))).alias(order))


def message_body(text: Column, most: int = 4_096) -> Column:
    return F.substring(text, 1, most)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What a bundle lacks."""
    return required.join(present.select(key), key, "left_anti")


def forbidden(present: DataFrame, key: str, endings: tuple[str, ...] = (".pdf", ".png", ".jpg", ".env")) -> DataFrame:
    """What a bundle must not have."""
    return present.where(F.lower(key).rlike("(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$"))

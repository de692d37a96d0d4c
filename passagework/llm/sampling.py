"""Bounded samples of labelled rows, the only thing that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import storage


def bounded(rows: DataFrame, label: str, most: int, salt: int = 0) -> DataFrame:
    """About `most` different texts of each label at the most, those with the least hash; all where there are fewer.

    The share to keep is set from the counts of the labels' texts, so no task gathers a label's rows."""
    kinds = rows.where(F.col(label).isNotNull()).select(label, F.xxhash64("_text").alias("h")).distinct()
    counts = {r[0]: r[1] for r in kinds.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.coalesce(*(F.when(F.col(label) == F.lit(k), F.lit(min(1.0, most / n))) for k, n in counts.items()))
    drawn = F.pmod(F.xxhash64("_text", F.lit(salt)), F.lit(1 << 20)) < share * (1 << 20)
    return rows.where(F.col(label).isNotNull() & drawn).select(label, "_text").distinct()


def labelled(docs: DataFrame, labels: DataFrame, learn, id_col: str, text_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(sample of _text and _label, about `most` rows of each label at the most; number of rows by label).

    Labels are 0 or 1. The sample is drawn on ids alone, by their hash, so texts are not shuffled: at most
    2 * most ids are broadcast to the scan of the texts. It is written once, as fitting reads it several times."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)")
    ids = docs.where(learn).select(F.col(id_col).alias("_id")).join(known, "_id")
    counts = {r[0]: r[1] for r in ids.groupBy("_label").count().collect()}
    share = F.coalesce(*(F.when(F.col("_label") == k, F.lit(min(1.0, most / n))) for k, n in counts.items()), F.lit(0.0))
    few = ids.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    texts = docs.where(learn).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return storage.saved(texts.join(F.broadcast(few), "_id").select("_text", "_label"), "sample"), counts

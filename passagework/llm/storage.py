"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.sources.shared import removed, shared_dir

#: Shuffle files go as soon as the table that they were made for is written.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a with block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def saved(df: DataFrame, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a plan cut that survives lost executors.

    more: session settings for the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, CLEAN | (more or {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str):
    """df as a table in the shared folder, bucketed by key, so that joins on the key do not shuffle it; gone after the with block."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")
        removed(spark, path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once nothing reads them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            removed(df.sparkSession, file.rsplit("/", 1)[0])


def parts_for(total: int, each: int) -> int:
    """How many partitions hold total units at each units apiece."""
    return max(1, -(-int(total) // each))


def keyed(docs: DataFrame, id_col: str, text_col: str, own: bool = True) -> tuple[DataFrame, bool]:
    """(_k long unique per row, id, text). A unique, non-null integral id is its own key; otherwise
    the rows are written once with a row number, so that the key stays the same when a task is redone."""
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(few.dtypes)["_id"]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        again = few.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _id is null")
        if not again.limit(1).count():
            return few.select(F.col("_id").cast("bigint").alias("_k"), "_id", "_text"), False
    return saved(few.select(F.monotonically_increasing_id().alias("_k"), "_id", "_text"), "rows"), True

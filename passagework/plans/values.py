"""Small tables given in the code, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with these rows."""
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"

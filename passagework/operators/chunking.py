"""From lines to sections and to chunks of bounded size. Lines carry a document, a number and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST, OVERLAP, LEAST = 1_400, 1, 120
SIZE, TAIL = 800, 200


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): the non-blank lines of a text, numbered from 0 in the order of the text."""
    each = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(id_col, F.posexplode(each).alias("line_no", "line"))


def sections(rows: DataFrame, header: Column, id_col: str = "doc_id") -> DataFrame:
    """Body lines with their section (from 1) and its header.

    The last header above a line is active; a new section starts where the active header's text differs
    from that of the line before. Header lines themselves are dropped; equal headers in a row are one section."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    marked = rows.withColumn("_head", header).withColumn("header", F.last(F.when(F.col("_head"), F.col("line")), True).over(order))
    body = marked.where(~F.col("_head"))
    fresh = ~F.col("header").eqNullSafe(F.lag("header").over(order)) | (F.row_number().over(order) == 1)
    return body.withColumn("_new", fresh.cast("int")).withColumn("section", F.sum("_new").over(order)).drop("_head", "_new")


_PART = "array<struct<first:int,last:int,chars:int>>"


def packed(rows: DataFrame, id_col: str = "doc_id", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, first, last, chars): greedy parts of lines, closed when the next would exceed `most`; each repeats the last `overlap` lines (0 or 1) of the one before."""
    sizes = rows.groupBy(id_col).agg(F.expr("transform(array_sort(collect_list(struct(line_no, length(line) as n))), x -> x.n)").alias("n"))
    start = f"struct(cast(array() as {_PART}) as parts, 0 as first, 0 as size)"
    back = f"greatest(i - {overlap}, 0)"
    step = f"if(acc.size + n[i] > {most} and i > acc.first, struct(array_append(acc.parts, struct(acc.first as first, i - 1 as last, acc.size as chars)) as parts, {back} as first, n[i] + {'n[' + back + ']' if overlap else '0'} as size), struct(acc.parts as parts, acc.first as first, acc.size + n[i] as size))"
    done = "array_append(acc.parts, struct(acc.first as first, size(n) - 1 as last, acc.size as chars))"
    parts = sizes.select(id_col, F.posexplode(F.expr(f"aggregate(sequence(0, size(n) - 1), {start}, (acc, i) -> {step}, acc -> {done})")).alias("part", "p"))
    return parts.select(id_col, "part", "p.*")


def packed_by_size(rows: DataFrame, id_col: str = "doc_id", size: int = SIZE, tail: int = TAIL) -> DataFrame:
    """(id, part, first, last, chars): parts closed once they reach `size`, without overlap; a last part under `tail` goes."""
    sizes = rows.groupBy(id_col).agg(F.expr("transform(array_sort(collect_list(struct(line_no, length(line) as n))), x -> x.n)").alias("n"))
    start = f"struct(cast(array() as {_PART}) as parts, 0 as first, 0 as size)"
    step = f"if(acc.size + n[i] >= {size}, struct(array_append(acc.parts, struct(acc.first as first, i as last, acc.size + n[i] as chars)) as parts, i + 1 as first, 0 as size), struct(acc.parts as parts, acc.first as first, acc.size + n[i] as size))"
    done = f"if(acc.size >= {tail}, array_append(acc.parts, struct(acc.first as first, size(n) - 1 as last, acc.size as chars)), acc.parts)"
    parts = sizes.select(id_col, F.posexplode(F.expr(f"aggregate(sequence(0, size(n) - 1), {start}, (acc, i) -> {step}, acc -> {done})")).alias("part", "p"))
    return parts.select(id_col, "part", "p.*")


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, n) of ids that occur more than once; a load is refused unless it is empty."""
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

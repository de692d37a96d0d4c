"""From characters and boxes to words, numbers, markers and lines. Rows carry page, line, a position and a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import rules

WATERMARK, WIDE, PILL, ASIDE, LOW, FIGURE = 470.0, 55.0, 46.0, 200.0, 15.0, 6_000.0


def box(*also: Column) -> list[Column]:
    """The box around a group's boxes."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *also]


def _runs(chars: DataFrame, inside: Column) -> DataFrame:
    """Characters inside runs, numbered: a run goes on as long as its line's characters are inside."""
    order = Window.partitionBy("page", "line").orderBy("pos")
    return chars.withColumn("_in", inside).withColumn("run", F.sum((~F.col("_in")).cast("int")).over(order)).where("_in")


def _text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "")


def words(chars: DataFrame) -> DataFrame:
    """(page, line, run, text, box): characters between blanks."""
    return _runs(chars, ~F.col("c").rlike("^\\s$")).groupBy("page", "line", "run").agg(_text().alias("text"), *box())


def numbers(chars: DataFrame) -> DataFrame:
    """Runs of digits; commas and points go on with a run but do not end it."""
    order = Window.partitionBy("page", "line").orderBy("pos")
    digit, mark = F.col("c").rlike("^[0-9]$"), F.col("c").isin(",", ".")
    marked = chars.withColumn("_other", F.sum((~digit & ~mark).cast("int")).over(order)).withColumn("_first", F.min(F.when(digit, F.col("pos"))).over(Window.partitionBy("page", "line", "_other")))
    runs = marked.where((digit | mark) & (F.col("pos") >= F.col("_first"))).groupBy("page", "line", "_other").agg(_text().alias("text"), *box())
    return runs.select("page", "line", F.rtrim("text", F.lit(",.")).alias("text"), "x0", "y0", "x1", "y1")


def not_watermark() -> Column:
    return F.abs(F.col("y1") - F.col("y0") - WATERMARK) >= 2


def markers(boxes: DataFrame, page_width: float) -> DataFrame:
    """Pills and asides with their kind, in reading order within a page (place)."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    text = F.col("text")
    n = F.size(F.filter(F.split(text, "\\s+"), lambda x: x != ""))
    pill = (high <= PILL) & (n <= 10) & (wide <= 0.62 * page_width)
    rows = boxes.where(F.col("filled") & (wide >= WIDE) & (high >= LOW) & (high <= ASIDE) & not_watermark() & n.between(2, F.when(pill, 10).otherwise(140)) & (F.regexp_count(text, F.lit("[ऀ-ॿ]+")) >= 2))
    label = rules.callout(text)
    kind = F.when(pill, F.concat(F.lit("section_header"), F.coalesce(F.concat(F.lit(":"), label), F.lit("")))).otherwise(F.coalesce(label, F.lit("aside")))
    place = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0"))
    return rows.select("page", place.alias("place"), kind.alias("kind"), "text", F.round(high, 1).alias("height"), rules.dropped_consonant(text).alias("label_uncertain"))


def figure_share(boxes: DataFrame, page_area: float) -> DataFrame:
    """(page, share) of the area of large images and filled drawings; overlaps count twice."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    large = (F.col("image") | F.col("filled")) & (area >= FIGURE) & not_watermark()
    return boxes.groupBy("page").agg(F.round(F.coalesce(F.sum(F.when(large, area)), F.lit(0.0)) / page_area, 3).alias("share"))


def assembled(rows: DataFrame) -> DataFrame:
    """(page, line, text, box): a line's words from left to right."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "id", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("page", "line").agg(text.alias("text"), *box())


def ocr_stats(rows: DataFrame) -> DataFrame:
    """Per page: words, mean and lower-quartile confidence, share under 60, dropped as junk."""
    order = Window.partitionBy("page").orderBy("conf", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("page"))
    placed = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", n)
    return placed.groupBy("page").agg(F.count(F.lit(1)).alias("words"), F.round(F.avg("conf"), 1).alias("mean"), F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 4), F.col("conf"))).alias("p25"), F.round(F.avg((F.col("conf") < 60).cast("double")), 3).alias("low_share"), F.count_if(rules.ocr_junk(F.col("text"), F.col("conf"))).alias("dropped"))


def substituted(word: Column, number: Column, used: Column) -> Column:
    """An OCR word with the text layer's number in place of its digits: all of a numeric word, else the first run; without a number its digits go, and the word if nothing of the script is left."""
    bare = F.regexp_replace(word, "[0-9०-९,.]+", "")
    mixed = F.regexp_replace(word, "^(.*?)[0-9०-९।॥][0-9,.०-९]*", F.concat(F.lit("$1"), number))
    return F.when(~word.rlike("[0-9०-९]"), word).when(number.isNull(), F.when(bare.rlike("[ऀ-ॿ]"), bare)).when(word.rlike("^[0-9०-९,./।॥]+$") | used, number).otherwise(mixed)

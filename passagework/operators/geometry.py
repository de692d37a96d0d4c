"""Boxes on pages: overlaps, containment, fractions from bars and digits, lines by band. Boxes are x0, y0, x1, y1.

All joins are on the page, so a page is the unit that must fit a task's join buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAR, THIN, SHARE, LEFT, RIGHT, BAND = 40.0, 3.0, 0.3, 24.0, 48.0, 1.0


def best_overlap(words: DataFrame, numbers: DataFrame, least: float = 0.15) -> DataFrame:
    """For each word the number box that covers the largest share of it, first on ties, if over `least`; columns page, id and the box."""
    w, n = words.alias("w"), numbers.alias("n")
    wide = F.greatest(F.lit(0.0), F.least("w.x1", "n.x1") - F.greatest("w.x0", "n.x0"))
    high = F.greatest(F.lit(0.0), F.least("w.y1", "n.y1") - F.greatest("w.y0", "n.y0"))
    cover = wide * high / F.greatest((F.col("w.x1") - F.col("w.x0")) * (F.col("w.y1") - F.col("w.y0")), F.lit(1e-9))
    both = w.join(n, F.col("w.page") == F.col("n.page")).select("w.page", F.col("w.id").alias("word"), F.col("n.id").alias("number"), cover.alias("cover")).where(F.col("cover") > least)
    first = Window.partitionBy("page", "word").orderBy(F.col("cover").desc(), "number")
    return both.withColumn("r", F.row_number().over(first)).where("r = 1").select("page", "word", "number", F.round("cover", 6).alias("cover"))


def bars(rules: DataFrame) -> DataFrame:
    """Rules that can be the bar of a fraction."""
    width = F.col("x1") - F.col("x0")
    return rules.where((width > THIN) & (width <= BAR) & (F.col("y1") - F.col("y0") < THIN))


def fractions(rules: DataFrame, digits: DataFrame) -> DataFrame:
    """(page, bar, text, numerator, denominator, x0, y0, x1, y1): nearest digits above and below each bar, and the box around all three."""
    b, d = bars(rules).alias("b"), digits.withColumn("digits", F.regexp_replace("text", "[^0-9]", "")).where("digits <> ''").alias("d")
    across = F.least("d.x1", "b.x1") - F.greatest("d.x0", "b.x0")
    middle = (F.col("d.y0") + F.col("d.y1")) / 2
    near = b.join(d, (F.col("b.page") == F.col("d.page")) & (across > SHARE * F.least(F.col("d.x1") - F.col("d.x0"), F.col("b.x1") - F.col("b.x0"))) & (middle != F.col("b.y0")))
    box = F.struct("d.id", "d.digits", "d.x0", "d.y0", "d.x1", "d.y1")
    above, under = middle < F.col("b.y0"), middle > F.col("b.y0")
    found = near.groupBy("b.page", F.col("b.id").alias("bar"), F.col("b.x0").alias("bx0"), F.col("b.y0").alias("by0"), F.col("b.x1").alias("bx1"), F.col("b.y1").alias("by1")).agg(
        F.max_by(F.when(above, box), F.when(above, F.struct(middle, -F.col("d.id")))).alias("n"), F.min_by(F.when(under, box), F.when(under, F.struct(middle, F.col("d.id")))).alias("u"))
    found = found.where("n is not null and u is not null")
    return found.select("page", "bar", F.concat_ws("/", "n.digits", "u.digits").alias("text"), F.col("n.id").alias("numerator"), F.col("u.id").alias("denominator"), F.least("bx0", "n.x0", "u.x0").alias("x0"), F.least("by0", "n.y0", "u.y0").alias("y0"), F.greatest("bx1", "n.x1", "u.x1").alias("x1"), F.greatest("by1", "n.y1", "u.y1").alias("y1"))


def outside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of points (boxes by their centre) that lie in none of the boxes of their page."""
    p, b = points.alias("p"), boxes.alias("b")
    x, y = (F.col("p.x0") + F.col("p.x1")) / 2, (F.col("p.y0") + F.col("p.y1")) / 2
    return p.join(b, (F.col("p.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1")), "left_anti")


def spliced(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, id, line): the line whose band holds a fraction's middle, nearest by x; null makes it a figure's label."""
    f, ln = found.alias("f"), lines.alias("l")
    middle = (F.col("f.y0") + F.col("f.y1")) / 2
    on = (F.col("f.page") == F.col("l.page")) & middle.between(F.col("l.y0") - BAND, F.col("l.y1") + BAND) & F.col("f.x0").between(F.col("l.x0") - LEFT, F.col("l.x1") + RIGHT)
    return f.join(ln, on, "left").groupBy(F.col("f.page").alias("page"), F.col("f.id").alias("id")).agg(F.min_by(F.col("l.id"), F.struct(F.abs(F.col("l.x0") - F.col("f.x0")), F.col("l.id"))).alias("line"))


def headed(lines: DataFrame, headers: DataFrame, slack: float = 3.0) -> DataFrame:
    """Lines with the last header of their page that starts above them, null if none does."""
    ln, h = lines.alias("l"), headers.alias("h")
    return ln.join(h, (F.col("l.page") == F.col("h.page")) & (F.col("h.y0") - slack <= F.col("l.y0")), "left").groupBy(F.col("l.page").alias("page"), F.col("l.id").alias("id")).agg(F.max_by(F.col("h.text"), F.struct(F.col("h.y0"), F.col("h.id"))).alias("header"))

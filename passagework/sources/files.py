"""Readers for the file shapes that the pipeline meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS_PER_INCH, POINTS_PER_INCH = 300, 72
OCR = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def listed_or_wrapped(spark: SparkSession, path: str, schema: str, under: str = "questions") -> DataFrame:
    """Rows of a JSON array, or of an object that has the array under a name."""
    columns = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(f"{schema}, {under} array<struct<{', '.join(f'{c}: {t}' for c, t in spark.createDataFrame([], schema).dtypes)}>>").json(path, multiLine=True)
    wrapped = rows.where(F.col(under).isNotNull()).select(F.explode(under).alias("_r")).select("_r.*")
    return rows.where(F.col(under).isNull()).select(*columns).unionByName(wrapped)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet that may not be there: then no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of OCR tables (tab-separated, unquoted) with their line's key and their box in points."""
    rows = spark.read.schema(OCR).option("sep", "\t").option("quote", "").option("header", True).option("mode", "PERMISSIVE").csv(path)
    scale = POINTS_PER_INCH / PIXELS_PER_INCH
    words = rows.where((F.col("level") == 5) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return words.select(
        F.col("page_num").alias("page"), F.concat_ws("-", "block_num", "par_num", "line_num").alias("line"), F.col("word_num").alias("id"), "text", F.col("conf").cast("int").alias("conf"),
        (F.col("left") * scale).alias("x0"), (F.col("top") * scale).alias("y0"), ((F.col("left") + F.col("width")) * scale).alias("x1"), ((F.col("top") + F.col("height")) * scale).alias("y1"),
    )


def settings(spark: SparkSession, path: str, held: dict[str, str] | None = None) -> DataFrame:
    """(key, value) of key=value lines; blank lines, comments and lines without = are skipped, quotes stripped, values already held win."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#") & line.contains("=")).select(F.trim(F.split_part(line, F.lit("="), F.lit(1))).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(line, "^[^=]*=(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("value"))
    own = spark.createDataFrame(list((held or {}).items()), "key string, held string")
    return rows.join(F.broadcast(own), "key", "left").select("key", F.coalesce("held", "value").alias("value"))


def pages_of(manifest: DataFrame) -> DataFrame:
    """(page, code, at): each printed page of the sections in use with its place in the section's file."""
    used = manifest.where("in_retrieval_corpus")
    return used.select("code", F.col("pdf_page_first").alias("_p"), F.posexplode(F.sequence("book_page_start", "book_page_end")).alias("_i", "page")).select("page", "code", (F.col("_p") + F.col("_i")).alias("at"))


def whole_files(spark: SparkSession, path: str, head: str = "%PDF", tail: str = "%%EOF", least: int = 10_000) -> DataFrame:
    """(path, complete) of files: the right first bytes, the end mark in the last 2048, and a size."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.col("content")
    ends = F.instr(F.decode(F.substring(text, -2048, 2048), "ISO-8859-1"), tail) > 0
    return rows.select("path", (F.col("length") >= least).alias("large"), (F.decode(F.substring(text, 1, len(head)), "ISO-8859-1") == head).alias("starts"), ends.alias("ends")).select("path", (F.col("large") & F.col("starts") & F.col("ends")).alias("complete"))


def cheapest(first: DataFrame, *others: DataFrame, key: str = "page", value: str = "source") -> DataFrame:
    """For each key the value of the first source that has one."""
    out = first.withColumnRenamed(value, "_0")
    for i, other in enumerate(others, 1):
        out = out.join(other.withColumnRenamed(value, f"_{i}"), key, "full")
    return out.select(key, F.coalesce(*(f"_{i}" for i in range(len(others) + 1))).alias(value))


def preferred(services: DataFrame, wanted: str = "hi") -> DataFrame:
    """Of each pipeline's services the one whose language is null or the wanted one, else the first; columns pipeline, place, language, service."""
    fits = F.col("language").isNull() | (F.col("language") == wanted)
    return services.groupBy("pipeline").agg(F.min_by("service", F.struct(~fits, "place")).alias("service"))

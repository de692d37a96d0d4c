"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last
return the columns of documents. A stage's operator says what it does with nulls and repeated rows.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import storage
from passagework.llm.byte_bpe import byte_bpe
from passagework.llm.decontaminate import decontaminate
from passagework.llm.language_id import language_id
from passagework.llm.simhash_dedup import near_duplicates
from passagework.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; lang keeps its given value."""
    found = language_id(docs, F.col("doc_id").isNotNull(), keep=tuple(COLUMNS[1:]))
    return found.where(~F.col("rejected")).select(COLUMNS)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, similarity 0.8 or more."""
    return near_duplicates(docs).select(COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row (_row): the id where it is unique and never null, else a row number, written once."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not again.limit(1).count():
        return docs.withColumn("_row", F.col("doc_id"))
    return storage.saved(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def whole_characters():
    """The texts without the byte ranges of spans and without what these leave of a character they cut."""

    def left(one, ranges):
        data, out, at = one.encode(), [], 0
        for r in ranges:
            a, b = r["start"], r["end"]
            while a > at and a < len(data) and data[a] & 0xC0 == 0x80:
                a -= 1
            out.append(data[at:a])
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            at = b
        return b"".join([*out, data[at:]]).decode()

    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([left(*x) for x in zip(text, spans)], dtype=object)

    return F.pandas_udf(run, "string")


def passages_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that also start elsewhere; a character that is cut in two goes. Null texts become empty."""
    rows = numbered(docs)
    found = suffix_dedup(rows, "_row").select("_row", "spans")
    text = F.coalesce("text", F.lit(""))
    return rows.join(found, "_row").withColumn("text", F.when(F.size("spans") > 0, whole_characters()(text, "spans")).otherwise(text)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows = numbered(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row")
    return rows.join(found.where("contaminated").select("_row"), "_row", "left_anti").select(COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digest of what they decode to."""
    done = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identified),
    ("SimHash near-deduplication", near_deduplicated),
    ("suffix-array deduplication", passages_removed),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokenized),
]

#: The fitted models and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = storage.saved(docs, f"stage{number}")
    return docs

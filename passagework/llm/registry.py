"""Registered queries of the operators for training text; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.byte_bpe import byte_bpe
from passagework.llm import licence_scan as licences
from passagework.llm.decontaminate import decontaminate
from passagework.llm.katz_lm import katz_scores
from passagework.llm.language_id import language_id
from passagework.llm.neighbour_quality import neighbour_quality
from passagework.llm.perplexity_rules import perplexity_rules
from passagework.llm.sentence_toxicity import sentence_toxicity
from passagework.llm.simhash_dedup import simhash_dedup
from passagework.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    done = language_id(docs, F.coalesce(_remainder(4) != 2, F.lit(False)))
    return done.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = neighbour_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.coalesce(_remainder(3) != 1, F.lit(False)))
    return done.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules(_table(spark, sf_dir, "documents"))


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_table(spark, sf_dir, "documents")).withColumn("notices", F.concat_ws(",", "notices"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sentence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentence_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.coalesce(_remainder(3) != 1, F.lit(False)))
    return done.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "contaminated", F.coalesce(F.size("matches"), F.lit(0)).alias("n_items"), F.col("matches.item").alias("item_ids"))


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_language_id": (op2_language_id, None),
    "op3_simhash_dedup": (op3_simhash_dedup, None),
    "op4_neighbour_quality": (op4_neighbour_quality, None),
    "op5_perplexity_rules": (op5_perplexity_rules, None),
    "op6_katz_lm": (op6_katz_lm, None),
    "op7_licence_scan": (op7_licence_scan, licences.oracle_sql()),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_sentence_toxicity": (op9_sentence_toxicity, None),
    "op10_decontaminate": (op10_decontaminate, None),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, lines, neardup, packing, quality, secrets, substrings, warc
from .common import read
from .oracles import ORACLES

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.quality_rules(docs.select("doc_id", "text"), model).drop("text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.ngram_components(read(spark, sf_dir, "documents"), shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.chat_digests(turns, TOKENIZER).drop("n_tokens")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(read(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.substring_dedup(read(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.line_dedup(read(spark, sf_dir, "documents")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that the base rules fix, through its operator."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, quality.DEFAULT_MODEL).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that the base phrases fix, through its operator."""
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("labels", "score")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that count base spans, through its operator."""
    return secrets.secret_scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_license_scan, op4_decontamination, op5_chat_formatting, op6_warc, op7_best_fit_packing, op8_substring_dedup, op9_secret_scan, op10_line_dedup, quality_base_counts, license_base_places, secret_base_counts)
}

__all__ = ["ORACLES", "QUERIES"]

"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import chat, decontaminate, fingerprint, lengthpack, passages, quality, recurrent, simhash, tokenpack, toxicity
from sievework.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def remainder(n: int) -> Column:
    """``doc_id``, as text, by CRC-32 modulo ``n``: decides which rows may be learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_robustness(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.packed(table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurrent.scored(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengthpack.batches(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.scored(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return toxicity.scored(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted", "worst_sentence"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_fingerprint": op3_fingerprint,
    "op4_tokens": op4_tokens,
    "op5_passages": op5_passages,
    "op6_chat": op6_chat,
    "op7_language_model": op7_language_model,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op6_chat": chat.ORACLE_SQL,
    "op8_packing": lengthpack.oracle_sql(),
}

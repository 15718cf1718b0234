"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candidate_funnel.llm import (
    chat, context_mixing, decontaminate, hard_negatives, language, mixture, odd_sketch, prefix_hash, quality,
    quality_rules, secret_battery, structure_repair, toxicity,
)
from candidate_funnel.llm.common import held_out, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.planted(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chat(rows))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3, 1)
    trees = language.fit(docs.select("doc_id", "lang", "text"), ~held)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return language.identify(rows, trees, ["doc_id", "held_out"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", 4, 2)
    return quality.classify(docs, labels, held, ~held)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", 5, 0)
    return toxicity.classify(docs, labels, held, ~held)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_battery.digest(secret_battery.scan(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.find(docs, items))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure_repair.damaged(table(spark, sf_dir, "conversations"))
    return structure_repair.report(rows, gone=F.col("gone"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("n_lines")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_minhash": op8_minhash,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_structure_repair": op11_structure_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_hard_negatives": op13_hard_negatives,
}

"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, features, jaccard, langid, licenses, maxent, mixing, pii, quality, runs, suffixes, vectors
from .common import tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removals(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(conversations.unionByName(chat.control_conversation(spark))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(runs.planted(_table(spark, sf_dir, "documents"))))


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(*[_table(spark, sf_dir, name) for name in ("clicks", "sales", "sale_lines")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scoring, op2_decontamination, op3_quality_classifier, op4_mixing, op5_nearest_neighbours, op6_ngram_jaccard, op7_language_id, op8_suffix_dedup, op9_pii, op10_license_scan, op11_chat_formatting, op12_periodic_runs, op13_point_in_time)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE_SQL, "op6_ngram_jaccard": jaccard.ORACLE_SQL, "op11_chat_formatting": chat.ORACLE_SQL, "op13_point_in_time": features.ORACLE_SQL}

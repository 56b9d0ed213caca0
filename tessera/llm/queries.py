"""The operators as driver queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_examples, hmm, line_rules, lsa, mixture, pii, quality, simhash, suffixes, toxicity
from .common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "keep")


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_examples.prefix_target_examples(table(spark, sf_dir, "conversations"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), mixture.production_targets(spark))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm": _op1,
        "op2_simhash": _op2,
        "op3_pii": _op3,
        "op4_line_rules": _op4,
        "op5_prefix_target": _op5,
        "op6_lsa": _op6,
        "op7_mixture": _op7,
        "op8_suffixes": _op8,
        "op9_quality": _op9,
        "op10_toxicity": _op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_rules": line_rules.ORACLE, "op5_prefix_target": chat_examples.ORACLE, "op7_mixture": mixture.ORACLE}

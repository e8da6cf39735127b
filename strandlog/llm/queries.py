"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunks, counts, decontaminate, html, packing, pii, quality, resampling, secrets, simhash, suffixes, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op3_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op3(table(spark, sf_dir, "documents"))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(table(spark, sf_dir, "documents"))


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2(table(spark, sf_dir, "documents"))


def op5_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.op5(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(table(spark, sf_dir, "documents"))


def op8_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op8(table(spark, sf_dir, "pages"))


def op9_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9(table(spark, sf_dir, "documents"))


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.op10(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_binary_packing, op2_secret_scan, op3_suffix_buckets, op4_quality_ledger, op5_content_chunks, op6_winnowing, op7_simhash_pigeonring, op8_tag_path_ratios, op9_bilstm_crf, op10_edit_aware_counts, op11_importance_resampling, op12_lexicon_automata, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.ORACLE, "op4_quality_ledger": quality.ORACLE, "op6_winnowing": decontaminate.ORACLE, "op11_importance_resampling": resampling.ORACLE}

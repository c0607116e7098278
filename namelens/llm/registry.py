"""The thin queries over these operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namelens.llm import chat, exactdedup, htmlmain, licenses, minhash, mixing, negatives, packing, pii, quality, simhash, spelling, toxicity
from namelens.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups_of(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(table(spark, sf_dir, "documents"))


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scans(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_hostile(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_quality_classifier, op3_minhash_fingerprints, op4_html_main_text, op5_exact_dedup, op6_license_scan, op7_toxic_segments, op8_pii_spans, op9_best_fit_packing, op10_simhash_near_dedup, op11_spelling_variants, op12_hard_negatives, op13_chat_formatting)}

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": mixing.ORACLE_SQL, "op5_exact_dedup": exactdedup.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL, "op13_chat_formatting": chat.ORACLE_SQL}

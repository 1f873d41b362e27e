"""The registered queries of this subpackage and their SQL, by name: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import op1_pii, op2_quality, op3_lm, op4_warc, op5_licenses, op6_lines, op7_near, op8_mix, op9_quality, op10_decontaminate, op11_conversations, op12_spelling, op13_topk
from tidebook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.score(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm.score(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_warc.score(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses.scan(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_lines.score(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_near.score(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mix.score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.score(table(spark, sf_dir, "documents"))


def op10_decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_conversations.score(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_spelling.score(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_topk.score(table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_pii_spans, op2_quality_classifier, op3_language_model, op4_warc_index, op5_license_scan, op6_line_dedup, op7_near_duplicates, op8_mix_sources,
    op9_quality_rules, op10_decontaminate_benchmark, op11_conversation_repair, op12_spelling_variants, op13_exact_top_k,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op4_warc_index": op4_warc.SQL, "op6_line_dedup": op6_lines.SQL, "op8_mix_sources": op8_mix.SQL, "op13_exact_top_k": op13_topk.SQL}

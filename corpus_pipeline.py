"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Quality rules, line dedup, near-duplicate removal, benchmark decontamination, then mixing sources to target weights.
All but the last return the columns of documents; the last repeats a document as often as the mix takes it. Rows with
nulls, empty or very long texts, repeated rows, empty tables and further columns go through every stage; what becomes
of them stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import op6_lines, op7_near, op8_mix, op9_quality, op10_decontaminate
from tidebook.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go, as they have too few words; repeated rows share a fate; figures on a band's edge stay."""
    return op9_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of their source's have. Null texts stay null; a text may become empty; null sources are one; a line just at the ratio stays."""
    return op6_lines.drop_boilerplate(docs, ["doc_id"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; of rows alike in id and text one. Texts without words are classes of their own and stay."""
    return op7_near.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and empty texts hold none and stay; a score of just the threshold goes."""
    return op10_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times, the same on every run. Null sources are one; texts without words weigh nothing; equal sizes go by a digest."""
    return op8_mix.emit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Near duplicates, alignment and tokenisers are beyond SQL; tests hold the run against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

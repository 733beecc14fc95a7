"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and gets its predecessor's result, written
as Parquet and read again; all but the last return the columns of documents.

Every stage decides row by row: rows without id, rows that repeat an id and extra
columns are carried along, null and empty texts are defined by the stage's operator,
texts are read whole, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import dart, decontam, exact, kneser, mixing
from quadrille.llm.common import fresh_path, remove, staging


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps; null and empty texts, and all where no label is trusted, stay."""
    return kneser.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id; null texts count as empty ones."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id; texts without words all stay."""
    return dart.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; texts without words, and all without items, stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document once per copy, with the copy's number in ``copy`` (``copy_2`` where that name is taken); a null source is one of its own."""
    return mixing.emit_copies(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mixing),
]

#: Neither the classifier nor signatures have a form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.split()[0]}")
        with staging(spark):  # a stage's own tables go with it, its input once the result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

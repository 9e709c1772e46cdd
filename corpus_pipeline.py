"""The corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents; the last
adds ``copies``, how often the mix takes a document. Other columns, whatever their names, are not carried on. Null and empty texts, null ids, sources and labels, repeated rows and very long texts go through
every stage as its operator says; an empty table gives an empty result in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontamination, mixing, near_dup, pii, quality
from tallyspark.llm.common import drop, newest, read, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return _columns(quality.keep_good(docs, read(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return _columns(near_dup.keep_one(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _columns(decontamination.contaminated(docs, read(spark, sf_dir, "benchmark"), out="_held").where("not _held"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = pii.sanitise(docs)
    return _columns(clean.withColumn("n_chars", F.length("text").cast("long")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often."""
    return mixing.mix(docs).select(*COLUMNS, "copies")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("source_mixing", source_mixing),
]

#: The classifier and the near-duplicate join are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again. What a stage stored for itself, and what it read of the stage before, goes once its
    result is written; the tables of the result itself stay until ``common.clear``."""
    docs, former = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        drop(spark, former)
        former = newest()
    return docs

"""From raw documents to a training mix, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``.  Rows of an empty table pass through; null texts
fall to the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontaminate import without_leaks
from millrace.llm.exchange import stored
from millrace.llm.mixing import mixed
from millrace.llm.outliers import keep_clean
from millrace.llm.passages import without_passages
from millrace.llm.setsketch import without_near_duplicates
from millrace.session import apply_settings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their group's estimate."""
    return keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 of 100 five-word shingles."""
    return without_near_duplicates(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document has."""
    return without_passages(docs, words=50, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and their copies in a mix of at most two repetitions."""
    return mixed(docs, repeats=2.0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Robust estimates, sketches and verified passages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

"""Cleaning and packing of a corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents` with the rows they keep. Rows with null, empty or very long texts,
equal rows and empty tables go through every stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.decontamination import decontaminated
from skilltrail.llm.near_dup import deduplicated
from skilltrail.llm.packing import pack_documents
from skilltrail.llm.quality_model import accepted, fitted
from skilltrail.llm.quality_rules import judged, measured
from skilltrail.llm.tokens import small_batches
from skilltrail.llm.training import fold
from skilltrail.session import cut


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network accepts; it learns from labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return accepted(docs, fitted(docs, labels.where(fold(F.col("doc_id"), 5) != 0)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected."""
    rows = judged(measured(docs.select(F.struct("*").alias("row"), "text", "source")))
    # A filter would be pushed below the measures, which would then be worked out again for
    # every element of every array; an explode of one or no row stays where it is.
    return rows.select(F.explode(F.array_compact(F.array(F.when(F.col("kept"), F.col("row"))))).alias("row")).select("row.*")


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return deduplicated(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any item of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 4096 tokens."""
    return pack_documents(docs)


def bounded(stage):
    """The stage in a session that hands texts to Python in small batches."""
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [
    (stage.__name__, bounded(stage))
    for stage in (quality_model, quality_rules, near_dup, decontamination, packing)
]

# Learned scores, sketches and token ids: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

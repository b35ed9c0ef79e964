"""Term counts, inverse document frequencies and unit vectors in long form.

A document is whatever the key columns name: a career, a listing, a user. IDF is
log2(N / df) without smoothing, so a skill found in every document weighs nothing
and leaves the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_WEIGHT = 1e-12


def term_counts(docs: DataFrame, key: list[str], skills: str = "skills") -> DataFrame:
    """Rows `(*key, skill, tf)`; pools all arrays that share a key."""
    return (
        docs.select(*key, F.explode_outer(skills).alias("skill"))
        .where(F.col("skill").isNotNull())
        .groupBy(*key, F.lower("skill").alias("skill"))
        .agg(F.count("*").alias("tf"))
    )


def pair_counts(rows: DataFrame, key: list[str], skill: str = "skill") -> DataFrame:
    """The same from rows that already hold one skill each."""
    return rows.groupBy(*key, F.lower(skill).alias("skill")).agg(F.count("*").alias("tf"))


def idf_value(n_docs: Column, df: Column) -> Column:
    return F.log2(n_docs / df)


def skill_idf(terms: DataFrame, n_docs: Column) -> DataFrame:
    """Rows `(skill, df, idf)` over one corpus; weightless skills are dropped."""
    return (
        terms.groupBy("skill")
        .agg(F.count("*").alias("df"))
        .withColumn("idf", idf_value(n_docs, F.col("df")))
        .where(F.col("idf") > _NO_WEIGHT)
    )


def scoped_idf(terms: DataFrame, sizes: DataFrame, scope: list[str], copies: str) -> DataFrame:
    """Rows `(*scope, skill, df, idf)` with one corpus per scope.

    `copies` is the number of documents a term row stands for, `sizes` holds
    `(*scope, n_docs)`.
    """
    return (
        terms.groupBy(*scope, "skill")
        .agg(F.sum(copies).alias("df"))
        .join(sizes, scope)
        .withColumn("idf", idf_value(F.col("n_docs"), F.col("df")))
        .where(F.col("idf") > _NO_WEIGHT)
        .drop("n_docs")
    )


def weigh(terms: DataFrame, idf: DataFrame, on: list[str]) -> DataFrame:
    """tf * idf per term row; terms outside the vocabulary vanish."""
    return terms.join(idf.select(*on, "idf"), on).withColumn("weight", F.col("tf") * F.col("idf"))


def unit_vectors(weighted: DataFrame, key: list[str]) -> DataFrame:
    """Scale every document to length one: rows `(*key, skill, weight)`."""
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return weighted.join(norms, key).select(
        *key, "skill", (F.col("weight") / F.col("norm")).alias("weight")
    )

"""Readers and writers of the stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_title, format_career, format_skill, title_career
from ..session import cut
from . import keys


def read_listings(spark: SparkSession, path: str, career: str | None = None) -> DataFrame:
    """Stored listings, partitioned by career; one career prunes to its files."""
    listings = spark.read.schema(schemas.LISTINGS).parquet(path)
    if career is None:
        return listings
    return listings.where(F.col("career") == format_career(F.lit(career)))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Stored skill dictionary."""
    return spark.read.schema(schemas.LEXICON).parquet(path)


def read_lexicon_csv(spark: SparkSession, path: str, column: str = "Skill") -> DataFrame:
    """Skill dictionary from a CSV file with a header, lowercased."""
    rows = spark.read.csv(path, header=True).where(F.col(column).isNotNull())
    skill = F.lower(column)
    return rows.select(
        skill.alias("skill"),
        format_skill(skill).alias("formatted"),
        F.monotonically_increasing_id().alias("ord"),
    )


def career_titles(lines: DataFrame, category: str = "category", line: str = "value") -> DataFrame:
    """Distinct `(category, title, career)` from lines of title lists."""
    return (
        lines.select(
            F.col(category).alias("category"),
            clean_title(F.col(line)).alias("title"),
            title_career(F.col(line)).alias("career"),
        )
        .where("career != ''")
        .distinct()
    )


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Title lists of a folder, one title per line, the file name as category."""
    lines = spark.read.text(path).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("category"), "value"
    )
    return career_titles(lines)


def known_careers(listings: DataFrame) -> DataFrame:
    """Careers that have listings."""
    return listings.select("career").distinct()


def has_skills() -> Column:
    """Only listings in which a skill was found are kept."""
    return F.coalesce(F.size("skills") > 0, F.lit(False))


def first_listings(
    batch: DataFrame, order: list[str | Column] | None = None, key: str = "unique_url"
) -> DataFrame:
    """The first row of a batch per key.

    Copies that agree in `order` are told apart by all their columns, so a repeated task
    chooses the same one. The limit on row_number drops copies before the shuffle.
    """
    order = list(order or ["searched_at"])
    ties = [F.xxhash64(*batch.columns), F.hash(*batch.columns)]
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order, *ties))
    return batch.withColumn("nth", nth).where("nth = 1").drop("nth")


def new_listings(
    batch: DataFrame, stored: DataFrame, order: list[str | Column] | None = None,
    key: str = "unique_url",
) -> DataFrame:
    """Rows of the batch to insert: the first per key, unless the key is stored.

    Stored keys are reduced to those of the batch first: a batch small enough to broadcast
    shuffles none of the others. Stored rows are never changed.
    """
    asked = batch.select(key).distinct()
    taken = stored.select(key).join(asked, key, "left_semi")
    return first_listings(batch, order, key).join(taken, key, "left_anti")


def _if_stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schemas.LISTINGS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_listings(spark: SparkSession, path: str) -> DataFrame:
    """The listing table, or an empty one before the first insert."""
    stored = _if_stored(spark, path)
    return spark.createDataFrame([], schemas.LISTINGS) if stored is None else stored


def insert_listings(batch: DataFrame, path: str, order: list[str | Column] | None = None) -> int:
    """Append the new rows of a batch to the listing table and count them.

    Rows without skills are dropped first, so they never hold back a later copy.
    Running the same batch again inserts nothing. Of what is stored, only the batch's part of
    the key index is read, and the URLs of files that are not in it yet. One writer at a time.
    """
    spark = batch.sparkSession
    fresh = first_listings(batch.where(has_skills()), order)
    stored = _if_stored(spark, path)
    if stored is not None:
        keys.index_new_files(stored, path)
        # Written, as it is read twice: for its keys, and for its rows.
        fresh = cut(fresh.select(*schemas.LISTINGS.fieldNames()))
        taken = keys.stored_keys(spark, path, fresh.select("unique_url"))
        fresh = fresh.join(taken, "unique_url", "left_anti")
    counter = Observation()
    # Rebalanced by career: few files per folder, while a hot career is split over tasks.
    rows = fresh.select(*schemas.LISTINGS.fieldNames()).hint("rebalance", "career")
    # Counted last: below the rebalance an empty batch would lose its counter.
    rows.observe(counter, F.count(F.lit(1)).alias("n_new")).write.mode("append").partitionBy(
        "career"
    ).parquet(path)
    return counter.get["n_new"]


def upsert_rules(new: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """Snapshot with the new rules and those stored ones they do not replace."""
    if overwrite:
        return new
    return new.unionByName(stored.join(new.select("rule_id"), "rule_id", "left_anti"))


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write a whole table; the path must not be one the table is read from."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

"""Lookups users do while typing: typeahead entries and known careers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TERM = 2


def typeahead(
    terms: DataFrame, entries: DataFrame, term: str = "term", entry: str = "entry"
) -> DataFrame:
    """Rows `(term, entry)`: entries that contain a typed term of two characters or more.

    Case is ignored. Every entry lists its substrings of the lengths that were typed,
    so terms and entries meet in an equi-join on equal text instead of all with all.
    """
    typed = (
        terms.select(F.col(term).alias("term"), F.lower(term).alias("part"))
        .where(F.length("part") >= MIN_TERM)
        .distinct()
    )
    lengths = typed.agg(F.collect_set(F.length("part")).alias("lengths")).scalar()
    sized = (
        entries.select(F.col(entry).alias("entry"))
        .distinct()
        .withColumn("length", F.explode(lengths))
        .where(F.length("entry") >= F.col("length"))
    )
    starts = F.sequence(F.lit(1), F.length("entry") - F.col("length") + 1)
    parts = F.array_distinct(
        F.transform(starts, lambda i: F.substring(F.lower("entry"), i, F.col("length")))
    )
    return sized.select("entry", F.explode(parts).alias("part")).join(typed, "part").select(
        "term", "entry"
    )


def known_requests(requests: DataFrame, careers: DataFrame) -> DataFrame:
    """Requests whose career is known."""
    return requests.join(careers.select("career").distinct(), "career", "left_semi")


def unknown_requests(requests: DataFrame, careers: DataFrame) -> DataFrame:
    """Requests whose career is not known."""
    return requests.join(careers.select("career").distinct(), "career", "left_anti")

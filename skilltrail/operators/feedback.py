"""Counters of what users suggest and report, and the state of their skill lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_career, format_skill

SKILL_ACTIONS = ["add_skill", "remove_skill"]


def spelling_counts(feedback: DataFrame) -> DataFrame:
    """Rows `(action, formatted, spelling, n, last_ts)` from skill suggestions.

    All the per-row work of the counters happens here, combined before the shuffle:
    a skill suggested a billion times leaves one row per spelling.
    """
    return (
        feedback.where(F.col("action").isin(*SKILL_ACTIONS))
        .groupBy(
            "action",
            format_skill(F.col("suggestion")).alias("formatted"),
            F.col("suggestion").alias("spelling"),
        )
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    )


def fold_spellings(spellings: DataFrame) -> DataFrame:
    """One counter per action and skill: `(action, formatted, skill, spellings, n, last_ts)`."""
    return spellings.groupBy("action", "formatted").agg(
        F.lower(F.max_by("spelling", F.struct("last_ts", "spelling"))).alias("skill"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("spelling", "n")))
        ).alias("spellings"),
        F.sum("n").alias("n"),
        F.max("last_ts").alias("last_ts"),
    )


def skill_feedback(feedback: DataFrame) -> DataFrame:
    """Counters of added and removed skills."""
    return fold_spellings(spelling_counts(feedback))


def merge_skill_feedback(stored: DataFrame, feedback: DataFrame) -> DataFrame:
    """Stored counters plus a new batch of suggestions."""
    # The latest spelling must stay the latest, so only that entry keeps its time.
    old = stored.select(
        "action", "formatted", "skill", "last_ts", F.explode("spellings").alias("spelling", "n")
    )
    latest = F.lower("spelling") == F.col("skill")
    old = old.select(
        "action", "formatted", "spelling", "n", F.when(latest, F.col("last_ts")).alias("last_ts")
    )
    both = old.unionByName(spelling_counts(feedback))
    return fold_spellings(
        both.groupBy("action", "formatted", "spelling").agg(
            F.sum("n").alias("n"), F.max("last_ts").alias("last_ts")
        )
    )


def career_feedback(feedback: DataFrame) -> DataFrame:
    """Counters of suggested careers: `(career, n)`."""
    return (
        feedback.where(F.col("action") == "add_career")
        .groupBy(format_career(F.col("suggestion")).alias("career"))
        .agg(F.count("*").alias("n"))
    )


def merge_career_feedback(stored: DataFrame, feedback: DataFrame) -> DataFrame:
    return (
        stored.select("career", "n")
        .unionByName(career_feedback(feedback))
        .groupBy("career")
        .agg(F.sum("n").alias("n"))
    )


def promote_careers(counters: DataFrame, known: DataFrame, min_count: int) -> DataFrame:
    """Careers suggested often enough that are not collected yet."""
    return counters.where(F.col("n") >= min_count).join(
        known.select("career").distinct(), "career", "left_anti"
    )


def add_skills(owned: DataFrame, new: DataFrame, user: str = "user_id") -> DataFrame:
    """Each user's skills with the new ones added, none twice."""
    return owned.select(user, "skill").union(new.select(user, "skill")).distinct()


def current_skills(actions: DataFrame, user: str = "user_id", order=("ts",)) -> DataFrame:
    """Skills each user has after an add / remove log: those last added, not removed.

    `max_by` combines before the shuffle, so a long log of one skill costs one row.
    """
    return (
        actions.groupBy(user, "skill")
        .agg(F.max_by("action", F.struct(*order)).alias("action"))
        .where(F.col("action") == "add")
        .drop("action")
    )

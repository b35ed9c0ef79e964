"""Skills a user could learn next for a career, and the learning plan built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.charts import bar_score, edge_width, strength_tier
from ..functions.text import format_career

# Fixed values of the method: skills combined in one rule, strength worth showing.
MAX_COMPLEXITY = 3
MIN_STRENGTH = 0.4


def known_skills(users: DataFrame, lexicon: DataFrame, user: str = "user_id") -> DataFrame:
    """Distinct lowercase skills of each user that the lexicon has."""
    names = lexicon.select(F.lower("skill").alias("skill")).distinct()
    return users.select(user, F.lower("skill").alias("skill")).distinct().join(
        names, "skill", "left_semi"
    ).select(user, "skill")


def skill_subsets(users: DataFrame, size: int, user: str = "user_id") -> DataFrame:
    """All sorted subsets of one size of each user's skills: rows `(user, subset)`.

    Works inside one row per user. `suggest_skills` does not need it: it finds the
    rules a user satisfies without listing subsets.
    """
    skills = users.select(user, "skill").distinct().groupBy(user).agg(
        F.array_sort(F.collect_list("skill")).alias("rest")
    )
    grown = skills.withColumn("subset", F.array().cast("array<string>"))
    for _ in range(size):
        grown = grown.select(
            user, "subset", "rest", F.posexplode("rest").alias("i", "skill")
        ).select(
            user,
            F.concat("subset", F.array("skill")).alias("subset"),
            F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"),
        )
    return grown.select(user, "subset")


def suggest_skills(
    requests: DataFrame,
    user_skills: DataFrame,
    rules: DataFrame,
    lexicon: DataFrame,
    user: str = "user_id",
    max_complexity: int = MAX_COMPLEXITY,
) -> DataFrame:
    """Rows `(user, career, suggested, confidence, complexity, used)`.

    A rule applies when the user has all of its antecedent. It is looked up by the
    first skill of the antecedent and checked against the user's whole skill set in
    the same row, so no subset is enumerated and nothing is regrouped.
    """
    known = known_skills(user_skills, lexicon, user)
    owned = known.groupBy(user).agg(F.array_sort(F.collect_list("skill")).alias("owned"))
    names = lexicon.select(F.lower("skill").alias("suggested")).distinct()
    usable = (
        rules.where(F.col("complexity") <= max_complexity)
        .join(names, F.lower(rules["suggested"]) == names["suggested"], "left_semi")
        .select("career", "antecedent", "suggested", "confidence", "complexity")
        .withColumn("skill", F.col("antecedent")[0])
    )
    asked = (
        requests.select(user, format_career(F.col("career")).alias("career"))
        .distinct()
        .join(owned, user)
        .select(user, "career", "owned", F.explode("owned").alias("skill"))
    )
    return (
        asked.join(usable, ["career", "skill"])
        .where(F.size(F.array_except("antecedent", "owned")) == 0)
        .where(~F.array_contains("owned", F.col("suggested")))
        .select(
            user, "career", "suggested", "confidence", "complexity",
            F.col("antecedent").alias("used"),
        )
    )


def suggestion_order() -> list[Column]:
    """Order of suggestions on a career page."""
    return [F.desc("complexity"), F.desc("confidence"), F.desc("suggested"), F.desc("used")]


def ordered_suggestions(
    suggestions: DataFrame, k: int | None = None, user: str = "user_id"
) -> DataFrame:
    """Number the suggestions of each user and career; optionally only the first k."""
    rank = F.row_number().over(W.partitionBy(user, "career").orderBy(*suggestion_order()))
    numbered = suggestions.withColumn("rank", rank)
    return numbered if k is None else numbered.where(F.col("rank") <= k)


def plan_edges(
    suggestions: DataFrame, min_strength: float = MIN_STRENGTH, user: str = "user_id"
) -> DataFrame:
    """Edges `(user, career, skill, suggested, strength, total, n_used, width)` of the plan.

    An edge is as strong as the best rule that uses the skill; a suggestion is as
    strong as its edges together and stays when that reaches `min_strength`.
    """
    group = [user, "career"]
    # One exchange serves the grouping and both windows below.
    rows = suggestions.select(
        *group, F.explode("used").alias("skill"), "suggested", "confidence"
    ).repartition(*group)
    edges = rows.groupBy(*group, "skill", "suggested").agg(F.max("confidence").alias("strength"))
    kept = edges.withColumn(
        "total", F.sum("strength").over(W.partitionBy(*group, "suggested"))
    ).where(F.round("total", 9) >= min_strength)
    page = W.partitionBy(*group)
    return kept.withColumn("n_used", F.size(F.collect_set("skill").over(page))).withColumn(
        "width",
        edge_width(
            F.col("strength"), F.min("strength").over(page), F.max("strength").over(page)
        ),
    )


def learning_plan(edges: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows `(user, career, suggested, strength, n_used, score, tier, rank)`, strongest first."""
    group = [user, "career"]
    order = W.partitionBy(*group).orderBy(F.desc(F.round("strength", 9)), "suggested")
    score = bar_score(F.col("strength"), F.col("n_used"))
    return (
        edges.groupBy(*group, "suggested")
        .agg(F.sum("strength").alias("strength"), F.max("n_used").alias("n_used"))
        .withColumn("score", score)
        .withColumn("tier", strength_tier(F.col("score")))
        .withColumn("rank", F.row_number().over(order))
    )

"""Career model: pooled skills per career, and the careers closest to each user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sizes import BROADCAST_BYTES, measured_bytes
from .ranking import DIGITS, rank_with_zeros
from .weights import pair_counts, skill_idf, term_counts, unit_vectors, weigh


@dataclass
class CareerModel:
    """Fitted model: `terms(career, skill, tf)`, `idf(skill, df, idf)`, `vectors(career, skill, weight)`."""

    terms: DataFrame
    idf: DataFrame
    vectors: DataFrame

    def save(self, path: str) -> None:
        for name in ("terms", "idf", "vectors"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CareerModel:
        return CareerModel(*(spark.read.parquet(f"{path}/{n}") for n in ("terms", "idf", "vectors")))


def fit_career_model(listings: DataFrame) -> CareerModel:
    """Fit over `listings(career, skills)`; one document per career."""
    return model_of_terms(term_counts(listings, ["career"]))


def model_of_terms(terms: DataFrame) -> CareerModel:
    """Fit from counted terms `(career, skill, tf)`.

    Counts and vectors are written once: the listings are scanned once, and a model that is
    measured before it is broadcast is not worked out twice.
    """
    terms = cut(terms)
    n_careers = terms.select("career").distinct().agg(F.count("*")).scalar()
    idf = cut(skill_idf(terms, n_careers))
    return CareerModel(terms, idf, cut(unit_vectors(weigh(terms, idf, ["skill"]), ["career"])))


def similarities(users: DataFrame, model: CareerModel, user: str = "user_id") -> DataFrame:
    """Rows `(user, career, sim)` for every pair with a common skill.

    A model whose measured size allows is broadcast: then a user's terms stay in the task that
    holds the user, where the sums are made, and no pair is shuffled.
    """
    asked = unit_vectors(weigh(pair_counts(users, [user]), model.idf, ["skill"]), [user])
    vectors = model.vectors
    if measured_bytes(vectors) <= BROADCAST_BYTES:
        # The user alone deals out the rows, so sums and ranks by user need no further exchange.
        asked, vectors = asked.repartition(user), F.broadcast(vectors)
    return (
        asked.withColumnRenamed("weight", "asked")
        .join(vectors, "skill")
        .groupBy(user, "career")
        .agg(F.round(F.sum(F.col("asked") * F.col("weight")), DIGITS).alias("sim"))
    )


def suggest_careers(
    users: DataFrame,
    model: CareerModel,
    k: int = 5,
    user: str = "user_id",
    owners: DataFrame | None = None,
) -> DataFrame:
    """Rows `(user, career, sim, rank)`: the k careers closest to each user's skills.

    `owners` names the users to answer, by default those with skill rows; one without any
    skill gets the first k careers at similarity 0.
    """
    first = model.terms.select("career").distinct().orderBy("career").limit(k)
    asking = (users if owners is None else owners).select(user).distinct()
    return rank_with_zeros(similarities(users, model, user), asking, first, [user], "career", k)

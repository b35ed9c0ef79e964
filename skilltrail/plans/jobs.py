"""Batch jobs: from saved pages to listings, model, rules and per-user results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import career_display, format_career
from ..operators import careers, extract, feedback, listings, lookup, rules, suggest
from ..session import cut
from ..sources import tables
from ..sources.pages import page_text


def pages_to_listings(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Saved listing pages as `LISTINGS` rows; pages without a known skill are left out.

    `pages` holds `(page_id, career, searched_at, title, location, unique_url, html)`.
    """
    text = page_text(pages).withColumnRenamed("text", "listing_text")
    found = extract.with_skills(text, lexicon, ["page_id"], "listing_text")
    return found.withColumn("career", format_career(F.col("career"))).select(
        *schemas.LISTINGS.fieldNames()
    )


def ingest_pages(
    pages: DataFrame, lexicon: DataFrame, path: str, order: list[str | Column] | None = None
) -> int:
    """Add the pages' listings to the listing table; returns how many were new."""
    return tables.insert_listings(pages_to_listings(pages, lexicon), path, order)


def reextract(stored: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Stored listings with their skills found anew, after the lexicon has changed."""
    return extract.with_skills(
        stored.drop("skills"), lexicon, ["unique_url"], "listing_text"
    ).select(*schemas.LISTINGS.fieldNames())


def mine_rules(
    stored: DataFrame, lexicon: DataFrame, old_rules: DataFrame | None = None, **settings
) -> DataFrame:
    """Rule table of all careers; rules of an earlier run stay unless found again."""
    found = rules.association_rules(rules.frequent_itemsets(stored, lexicon, **settings))
    return found if old_rules is None else tables.upsert_rules(found, old_rules)


@dataclass
class CareerPages:
    """Result tables of the career pages."""

    careers: DataFrame
    listings: DataFrame
    suggestions: DataFrame
    edges: DataFrame
    plan: DataFrame
    unknown: DataFrame

    def save(self, path: str) -> None:
        for name in self.__dataclass_fields__:
            tables.write_snapshot(getattr(self, name), f"{path}/{name}")


def career_pages(
    requests: DataFrame,
    user_skills: DataFrame,
    stored: DataFrame,
    model: careers.CareerModel,
    rule_table: DataFrame,
    lexicon: DataFrame,
    k: int = 5,
    user: str = "user_id",
) -> CareerPages:
    """Everything shown to users, for all users and the careers they ask for.

    `requests` holds `(user, career)` in any spelling of the title; careers without
    listings come back as `unknown`.
    """
    keyed = requests.withColumn("career", format_career(F.col("career")))
    known = tables.known_careers(stored)
    wanted = lookup.known_requests(keyed, known)
    owners = user_skills.select(user).union(requests.select(user))
    close = careers.suggest_careers(user_skills, model, k, user, owners)
    tips = cut(suggest.suggest_skills(wanted, user_skills, rule_table, lexicon, user))
    edges = cut(suggest.plan_edges(tips, user=user))
    ranked = listings.rank_listings(wanted, user_skills, stored, k, user)
    return CareerPages(
        careers=close.withColumn("title", career_display(F.col("career"))),
        listings=listings.describe_listings(ranked, stored),
        suggestions=suggest.ordered_suggestions(tips, user=user),
        edges=edges,
        plan=suggest.learning_plan(edges, user),
        unknown=lookup.unknown_requests(keyed, known),
    )


def fold_feedback(
    batch: DataFrame, skills: DataFrame | None = None, career_counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Skill and career counters with a batch of suggestions added."""
    new_skills = (
        feedback.skill_feedback(batch)
        if skills is None
        else feedback.merge_skill_feedback(skills, batch)
    )
    new_careers = (
        feedback.career_feedback(batch)
        if career_counts is None
        else feedback.merge_career_feedback(career_counts, batch)
    )
    return new_skills, new_careers


@dataclass
class Store:
    """Folder of the stored tables; models and rules are versioned by run name."""

    path: str

    @property
    def listings(self) -> str:
        return f"{self.path}/listings"

    def model(self, run: str) -> str:
        return f"{self.path}/model/{run}"

    def rules(self, run: str) -> str:
        return f"{self.path}/rules/{run}"


def wanted_careers(
    spark: SparkSession, store: Store, titles: DataFrame | None = None
) -> DataFrame:
    """Careers to refresh: those of the title lists, or all that have listings."""
    if titles is not None:
        return titles.select("career").distinct()
    return tables.known_careers(tables.stored_listings(spark, store.listings))


def refresh(
    pages: DataFrame,
    lexicon: DataFrame,
    store: Store,
    run: str,
    previous: str | None = None,
    titles: DataFrame | None = None,
    **settings,
) -> int:
    """Weekly job: insert listings of the wanted careers, refit model and rules."""
    spark = pages.sparkSession
    careers_now = wanted_careers(spark, store, titles)
    keyed = pages.withColumn("career", format_career(F.col("career")))
    n_new = ingest_pages(lookup.known_requests(keyed, careers_now), lexicon, store.listings)
    stored = tables.read_listings(spark, store.listings)
    careers.fit_career_model(stored).save(store.model(run))
    old = spark.read.schema(schemas.RULES).parquet(store.rules(previous)) if previous else None
    tables.write_snapshot(mine_rules(stored, lexicon, old, **settings), store.rules(run))
    return n_new

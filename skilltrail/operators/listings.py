"""Listings closest to a user's skills within one career.

Every career is its own corpus: IDF counts that career's listings only. Listings with
the same skill bag have the same similarity to everyone, so the search runs over
distinct bags (and distinct askers) and expands to listings at the end; a career in
which a third of the listings are copies costs one bag.

The search is exact but does not read every posting of an asker's skills. The postings
of a career and skill lie in levels of falling impact (a weight, or a set size), each cut
into blocks of bounded size; a short list is one block. A first round reads a few blocks of the greatest impact per
asker; the score that k profiles reach there tells which levels could still hold a
profile that beats it, and only their blocks are read in the second round. Levels left
unread are looked up for the few pairs that their bounds leave in question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import format_career
from ..session import cut
from .ranking import DIGITS, rank_with_zeros, top_k
from .weights import scoped_idf, weigh

# Wider than the rounding of a reported similarity.
_SLACK = 2e-6

# Postings of a block, about. A shorter list is one block of the level -1; a longer one has
# levels, and as many parts in each as would hold the list in blocks of this size.
BLOCK_POSTINGS = 512

# Levels per halving of a weight or doubling of a set size, and the last of all levels.
_STEPS, _LAST_LEVEL = 4, 48

# Postings per asker read in the first round, as a multiple of k.
_FIRST_ROUND = 64


def _digest(value: Column) -> Column:
    """128-bit name of a value."""
    return F.unhex(F.md5(F.to_json(value)))


def askers_of(requests: DataFrame, user_skills: DataFrame, user: str = "user_id") -> DataFrame:
    """Requests `(user, career)` with the asker they stand for.

    An asker is a career with a bag of skills; users with equal skills share one.
    """
    counted = user_skills.groupBy(user, F.lower("skill").alias("skill")).agg(
        F.count("*").alias("tf")
    )
    bags = counted.groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct("skill", "tf"))).alias("bag")
    )
    empty = F.array().cast("array<struct<skill:string,tf:bigint>>")
    return (
        requests.select(user, "career")
        .distinct()
        .join(bags, user, "left")
        .withColumn("bag", F.coalesce("bag", empty))
        .withColumn("asker", _digest(F.struct("career", "bag")))
    )


def _bags(listings: DataFrame, distinct: bool) -> DataFrame:
    """Rows `(career, unique_url, bag, name)`: sorted skills and the name of that bag.

    Written once: later passes read the names without the bags.
    """
    words = F.transform("skills", F.lower)
    words = F.array_distinct(words) if distinct else words
    return cut(
        listings.where(F.size("skills") > 0)
        .select(
            "career",
            F.col("unique_url").cast("string").alias("unique_url"),
            F.sort_array(words).alias("bag"),
        )
        .withColumn("name", _digest(F.col("bag")))
    )


def _profile_skills(bags: DataFrame) -> DataFrame:
    """Rows `(career, name, profile, copies, n_listed, skill)` of distinct bags.

    A profile is called by the first URL that has its bag.
    """
    return (
        bags.groupBy("career", "name")
        .agg(
            F.min("unique_url").alias("profile"),
            F.count("*").alias("copies"),
            F.first("bag").alias("bag"),
        )
        .select(
            "career", "name", "profile", "copies", F.size("bag").alias("n_listed"),
            F.explode("bag").alias("skill"),
        )
    )


def _profile_terms(bags: DataFrame) -> DataFrame:
    """Rows `(career, profile, copies, n_listed, skill, tf)` of distinct bags.

    The name stays a key to the end, so the counts need no exchange beyond the one that brings
    equal bags together.
    """
    return (
        _profile_skills(bags)
        .groupBy("career", "name", "profile", "copies", "n_listed", "skill")
        .agg(F.count("*").alias("tf"))
        .drop("name")
    )


def _members(bags: DataFrame, k: int) -> DataFrame:
    """First k listings of every profile; no later copy can reach a top k."""
    first = top_k(
        bags.select("career", "unique_url", "name"), ["career", "name"], [F.col("unique_url")], k
    )
    same = W.partitionBy("career", "name")
    return first.select("career", "unique_url", F.min("unique_url").over(same).alias("profile"))


def _expand(
    sims: DataFrame, bags: DataFrame, asked: DataFrame, askers: DataFrame, user: str, k: int
) -> DataFrame:
    """From top profiles per asker to top listings per user."""
    best = top_k(sims.where("sim > 0"), ["asker"], [F.desc("sim"), F.col("profile")], k)
    listed = best.join(_members(bags, k), ["career", "profile"]).select(
        "asker", "career", "unique_url", "sim"
    )
    first = top_k(bags.select("career", "unique_url"), ["career"], [F.col("unique_url")], k)
    ranked = rank_with_zeros(
        listed, askers, first.drop("rank"), ["asker", "career"], "unique_url", k
    )
    return asked.select(user, "asker").join(ranked, "asker").drop("asker")


@dataclass
class Index:
    """Postings of the asked skills.

    `postings(career, skill, n_listing, level, profile, value)` flat, for single look-ups, and
    `blocks(career, skill, level, part, n, top, listed)`, where `listed` holds some
    `(profile, value)` of a level and `top` the greatest value in it.
    """

    postings: DataFrame
    blocks: DataFrame

    @staticmethod
    def build(postings: DataFrame, level: Column, block: int = BLOCK_POSTINGS) -> Index:
        """From `(career, skill, n_listing, profile, value)`; short lists get the level -1.

        `n_listing` counts the listings with the skill, so that a hot skill has many parts and
        no block, and no group in building it, grows with its list.
        """
        flat = cut(
            postings.withColumn(
                "level", F.when(F.col("n_listing") <= block, F.lit(-1)).otherwise(level)
            )
        )
        parts = F.greatest(F.lit(1), F.ceil(F.col("n_listing") / block)).cast("long")
        blocks = flat.groupBy(
            "career", "skill", "level", F.pmod(F.xxhash64("profile"), parts).alias("part")
        ).agg(
            F.count("*").alias("n"),
            F.max("value").alias("top"),
            F.collect_list(F.struct("profile", "value")).alias("listed"),
        )
        return Index(flat, cut(blocks))

    def levels(self) -> DataFrame:
        """Rows `(career, skill, level, n, top, first, n_first)`; `first` is a part of the level."""
        return self.blocks.groupBy("career", "skill", "level").agg(
            F.sum("n").alias("n"),
            F.max("top").alias("top"),
            F.min("part").alias("first"),
            F.min_by("n", "part").alias("n_first"),
        )

    def read(self, wanted: DataFrame, on: list[str]) -> DataFrame:
        """The wanted rows with `profile` and `value` of every posting of their blocks."""
        kept = [c for c in wanted.columns if c not in on]
        return wanted.join(self.blocks.select(*on, "listed"), on).select(
            *on, *kept, F.inline("listed")
        )


_LEVEL, _BLOCK = ["career", "skill", "level"], ["career", "skill", "level", "part"]


def _first_round(plan: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Blocks to read first: one part of each level, in order, until they hold enough postings."""
    so_far = F.sum("n_first").over(
        W.partitionBy("asker").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        plan.withColumn("so_far", F.coalesce(so_far, F.lit(0)))
        .where(F.col("so_far") < k * _FIRST_ROUND)
        .withColumnRenamed("first", "part")
        .drop("so_far", "n", "top", "n_first")
    )


def _known_score(reached: DataFrame, k: int) -> DataFrame:
    """Rows `(asker, known)`: a score that k profiles of the asker reach."""
    return (
        top_k(reached, ["asker"], [F.desc("score"), F.col("profile")], k)
        .where(F.col("rank") == k)
        .select("asker", F.col("score").alias("known"))
    )


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, "asker", "left").withColumn("known", F.coalesce("known", F.lit(0.0)))


def weight_level(weight: Column) -> Column:
    """Level of a weight in (0, 1]: quarters of halvings, the smallest weights together."""
    return F.least(F.floor(-F.log2(weight) * _STEPS), F.lit(_LAST_LEVEL)).cast("int")


def size_level(size: Column) -> Column:
    """Level of a set size: small sizes by themselves, then quarters of doublings, without end."""
    return F.when(size <= 16, size).otherwise(
        16 + F.floor(F.log2(size / 16) * _STEPS)
    ).cast("int")


def _marked_by_impact(plan: DataFrame) -> DataFrame:
    """Levels with `unread` and, of what an asker leaves unread, the bounds it keeps.

    Levels are left in rising impact while profiles found in nothing else stay below the known
    score. Such a profile has at most the impact of the greatest unread level of each skill,
    added up (`sums`); and, as listed vectors have length one, at most the length of the asker's
    vector on these skills (`squares`, Cauchy-Schwarz).
    """
    weakest = W.partitionBy("asker", "skill").orderBy("impact", F.desc("level"))
    rising = (
        W.partitionBy("asker").orderBy("impact", "skill", F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    )
    below = F.lag("impact").over(weakest)
    stepped = plan.withColumn("impact", F.col("asked") * F.col("top")).withColumns(
        {
            "added": F.col("impact") - F.coalesce(below, F.lit(0.0)),
            "square": F.when(below.isNull(), F.col("asked") ** 2).otherwise(0.0),
        }
    )
    bound = F.least(F.sum("added").over(rising), F.sqrt(F.sum("square").over(rising)))
    return stepped.withColumn("unread", bound + F.lit(_SLACK) < F.col("known")).drop("added", "square")


def _cosine(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """Exact similarities of every profile that may be among an asker's first k."""
    product = F.col("asked") * F.col("value")
    levels = asked.join(index.levels(), ["career", "skill"])
    # Adding up only what the first blocks show never exceeds the whole similarity.
    falling = [F.desc(F.col("asked") * F.col("top")), F.col("skill"), F.col("level")]
    reached = (
        index.read(_first_round(levels, k, falling), _BLOCK)
        .groupBy("asker", "profile")
        .agg(F.sum(product).alias("score"))
    )
    plan = _marked_by_impact(_with_known(levels, _known_score(reached, k)))
    # Per skill what its unread levels can still bring, and the level from which they are unread.
    left = F.when(F.col("unread"), F.col("impact"))
    skill, asker = W.partitionBy("asker", "skill"), W.partitionBy("asker")
    plan = plan.withColumns(
        {
            "left": F.coalesce(F.max(left).over(skill), F.lit(0.0)),
            "from": F.min(F.when(F.col("unread"), F.col("level"))).over(skill),
            "one": F.row_number().over(skill.orderBy("level")) == 1,
        }
    )
    some = F.when(F.col("one") & F.col("from").isNotNull(), F.col("left"))
    plan = cut(
        plan.withColumns(
            {
                "sums": F.coalesce(F.sum(some).over(asker), F.lit(0.0)),
                "squares": F.coalesce(
                    F.sum(F.when(some.isNotNull(), F.col("asked") ** 2)).over(asker), F.lit(0.0)
                ),
            }
        )
    )
    wanted = plan.where("not unread").select(
        *_LEVEL, "asker", "asked", "left", "known", "sums", "squares", F.col("from").isNotNull().alias("halved")
    )
    found = (
        index.read(wanted, _LEVEL)
        .groupBy("asker", "career", "profile")
        .agg(
            F.sum(product).alias("part"),
            F.sum("left").alias("met"),
            F.sum(F.when(F.col("halved"), F.col("asked") ** 2).otherwise(0.0)).alias("met_squares"),
            F.first("known").alias("known"),
            F.first("sums").alias("sums"),
            F.first("squares").alias("squares"),
        )
    )
    # A skill met in a read level is in no unread one.
    rest = F.least(
        F.col("sums") - F.col("met"),
        F.sqrt(F.greatest(F.col("squares") - F.col("met_squares"), F.lit(0.0))),
    )
    open_pairs = _contenders(found, F.col("part"), F.col("part") + rest, k)
    unread = plan.where("one and from is not null").select("asker", "skill", "asked", "from")
    missing = (
        open_pairs.where("sums > 0")
        .select("asker", "career", "profile")
        .join(unread, "asker")
        .join(index.postings, ["career", "profile", "skill"])
        .where("level >= from")
        .select("asker", "career", "profile", product.alias("part"))
    )
    return (
        open_pairs.select("asker", "career", "profile", "part")
        .unionByName(missing)
        .groupBy("asker", "career", "profile")
        .agg(F.round(F.sum("part"), DIGITS).alias("sim"))
    )


def _contenders(found: DataFrame, reached: Column, best_case: Column, k: int) -> DataFrame:
    """Pairs whose best case may still be among the asker's first k; written once."""
    scored = found.withColumns({"score": reached, "best": best_case})
    better = _known_score(scored, k).withColumnRenamed("known", "better")
    return cut(
        scored.join(better, "asker", "left")
        .where(F.col("best") + F.lit(_SLACK) >= F.greatest("known", F.coalesce("better", F.lit(0.0))))
        .drop("better", "best", "score")
    )


def _overlap(shared: Column, listed: Column) -> Column:
    return shared / (F.col("n_asked") + listed - shared)


def _jaccard(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The same for shared over joint skills.

    Levels are set sizes, and `value` is a profile's size. Of a level whose least size is l, a
    profile that has only m of an asker's skills scores at most m / (asked + max(l, m) - m);
    the m commonest skills of the level are left unread while that stays below the known score.
    """
    levels = asked.join(index.levels(), ["career", "skill"]).withColumn("least", -F.col("top"))
    count, size = F.count("*").alias("shared"), F.col("n_listed")
    potential = F.least("n_asked", "least") / F.greatest("n_asked", "least")
    order = [F.desc(potential), F.col("n_first"), F.col("skill"), F.col("level")]
    reached = (
        index.read(_first_round(levels, k, order), _BLOCK)
        .withColumn("n_listed", -F.col("value"))
        .groupBy("asker", "profile", "n_asked", "n_listed")
        .agg(count)
        .withColumn("score", _overlap(F.col("shared"), size))
    )
    known = _with_known(levels, _known_score(reached, k))
    commonest = W.partitionBy("asker", "level").orderBy(F.desc("n"), "skill")
    m = F.row_number().over(commonest)
    # The least size of the level, over all of the asker's skills.
    least = F.min("least").over(W.partitionBy("asker", "level"))
    low = _overlap(m, F.greatest(least, m)) + F.lit(_SLACK) < F.col("known")
    # Short lists are of all sizes, and read in any case.
    plan = cut(known.withColumn("unread", (F.col("level") >= 0) & low))
    pair = ["asker", "career", "profile", "n_asked", "n_listed"]
    found = (
        index.read(plan.where("not unread").select(*_LEVEL, "asker", "n_asked", "known"), _LEVEL)
        .withColumn("n_listed", -F.col("value"))
        .groupBy(*pair)
        .agg(count, F.first("known").alias("known"))
        .withColumn("level", size_level(size))
    )
    unread = plan.where("unread").select("asker", "level", "skill")
    tails = unread.groupBy("asker", "level").agg(F.count("*").alias("tail"))
    found = found.join(tails, ["asker", "level"], "left").withColumn(
        "tail", F.coalesce("tail", F.lit(0))
    )
    most = F.col("shared") + F.least(F.col("tail"), size - F.col("shared"))
    open_pairs = _contenders(found, _overlap(F.col("shared"), size), _overlap(most, size), k)
    missing = (
        open_pairs.where("tail > 0")
        .select(*pair, "level")
        .join(unread, ["asker", "level"])
        .join(index.postings.select("career", "profile", "skill"), ["career", "profile", "skill"])
        .select(*pair, F.lit(1).cast("long").alias("shared"))
    )
    return (
        open_pairs.select(*pair, "shared")
        .unionByName(missing)
        .groupBy(*pair)
        .agg(F.sum("shared").alias("total"))
        .withColumn("sim", F.round(_overlap(F.col("total"), size), DIGITS))
    )


def _asked_only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Only rows of a career and skill that someone asks for are ever looked at."""
    return rows.join(asked.select("career", "skill").distinct(), ["career", "skill"], "left_semi")


def _cosine_index(bags: DataFrame, askers: DataFrame) -> tuple[Index, DataFrame]:
    """Index of the profiles' unit vectors, and the askers' unit vectors.

    Lengths are added up from all skills, postings are kept for asked skills alone.
    """
    # Read for the IDF and for the weights.
    terms = cut(_profile_terms(bags))
    sizes = bags.groupBy("career").agg(F.count("*").alias("n_docs"))
    idf = scoped_idf(terms, sizes, ["career"], "copies")
    # Nearly as many skills as terms: met where the counts lie, never sent to every task, and
    # looked up, so that terms need not be sorted.
    weighted = cut(
        terms.join(idf.hint("shuffle_hash"), ["career", "skill"]).select(
            "career", "profile", "skill", "df", "idf", (F.col("tf") * F.col("idf")).alias("weight")
        )
    )
    norms = weighted.groupBy("career", "profile").agg(
        F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")
    )
    said = cut(askers.select("asker", "career", F.inline("bag")))
    postings = _asked_only(weighted, said).join(norms, ["career", "profile"])
    value = F.col("weight") / F.col("norm")
    index = Index.build(
        postings.select(
            "career", "skill", F.col("df").alias("n_listing"), "idf", "profile", value.alias("value")
        ),
        weight_level(F.col("value")),
    )
    # A skill that some listing has, but not all, has postings, and these its IDF.
    spread = index.postings.groupBy("career", "skill").agg(F.first("idf").alias("idf"))
    weights = weigh(said, spread, ["career", "skill"])
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy("asker")))
    return index, cut(
        weights.select("asker", "career", "skill", (F.col("weight") / norm).alias("asked"))
    )


def _jaccard_index(bags: DataFrame, wanted: DataFrame) -> Index:
    """Index of the profiles' set sizes, as negative values: small sets have the greater impact."""
    # The bags are sets: every skill of a profile is there once.
    terms = cut(_asked_only(_profile_skills(bags).drop("name"), wanted))
    lists = terms.groupBy("career", "skill").agg(F.count("*").alias("n_listing"))
    return Index.build(
        terms.join(lists, ["career", "skill"]).select(
            "career", "skill", "n_listing", "profile", (-F.col("n_listed")).alias("value")
        ),
        size_level(-F.col("value")),
    )


def rank_listings(
    requests: DataFrame,
    user_skills: DataFrame,
    listings: DataFrame,
    k: int = 5,
    user: str = "user_id",
) -> DataFrame:
    """Rows `(user, career, unique_url, sim, rank)`: k listings per requested career.

    Careers may be asked for in any spelling of the title; they come back as keys. Jobs that
    write intermediate tables run while the plan is being built.
    """
    requests = requests.withColumn("career", format_career(F.col("career")))
    bags = _bags(listings, distinct=False)
    asked = cut(askers_of(requests, user_skills, user))
    askers = asked.select("asker", "career", "bag").distinct()
    index, vectors = _cosine_index(bags, askers)
    return _expand(_cosine(index, vectors, k), bags, asked, askers.drop("bag"), user, k)


def rank_listings_jaccard(
    requests: DataFrame,
    user_skills: DataFrame,
    listings: DataFrame,
    k: int = 5,
    user: str = "user_id",
) -> DataFrame:
    """The same with shared over joint distinct skills as similarity."""
    requests = requests.withColumn("career", format_career(F.col("career")))
    bags = _bags(listings, distinct=True)
    asked = cut(askers_of(requests, user_skills.select(user, "skill"), user))
    askers = asked.select("asker", "career", "bag").distinct()
    wanted = cut(
        askers.select(
            "asker", "career", F.size("bag").alias("n_asked"), F.explode("bag.skill").alias("skill")
        )
    )
    index = _jaccard_index(bags, wanted)
    return _expand(_jaccard(index, wanted, k), bags, asked, askers.drop("bag"), user, k)


def describe_listings(ranked: DataFrame, listings: DataFrame) -> DataFrame:
    """Add title and location to ranked listings."""
    return ranked.join(
        listings.select("unique_url", "title", "location"), "unique_url", "left"
    )

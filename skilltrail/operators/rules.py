"""Association rules per career with a support that adapts to each career.

Support starts at 1/2 and is halved until a career has enough frequent itemsets. All
careers are mined together. Item counts alone tell how many halvings cannot suffice
(m frequent items have at most 2^m - 1 itemsets), and one pass looks several halvings
ahead: after every itemset size the lowest support still needed is recomputed per
career, so from the third size on no career is mined deeper than its own final support.

Mining is vertical. A career's distinct item sets are numbered in chunks of 64, and an itemset
carries, per chunk, one 64-bit word with the sets that hold it. Itemsets of a chunk that differ
in their last item only form a projection, and the next size comes from intersecting their
words inside it: no prefix is grown twice, and no group grows with a hot career or item. Sets
that stand for many listings are numbered once per binary digit of their multiplicity, so that
a frequency is a sum of bit counts times powers of two.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, cut_counted

# Fixed values of the method.
ENOUGH_ITEMSETS = 300
MIN_LISTINGS = 20
MIN_CONFIDENCE = 0.1

_LOOK_AHEAD = 3


_CHUNK = ["career", "digit", "chunk"]


def transactions(listings: DataFrame) -> DataFrame:
    """Distinct item sets per career with `w`, the number of listings that have them.

    A listing without items still counts as a listing of its career.
    """
    items = F.array_sort(F.array_distinct(F.transform("skills", F.lower)))
    sets = listings.select("career", items.alias("items"))
    return sets.groupBy("career", "items").agg(F.count("*").alias("w"))


def _numbered(sets: DataFrame) -> DataFrame:
    """Sets with `chunk` and `place` (0 to 63); similar ones lie side by side.

    The numbers have to be written before they are used: a repeated task could give others.
    """
    row = F.monotonically_increasing_id()
    return sets.sortWithinPartitions("career", "items").select(
        "career", "items", "w", F.shiftright(row, 6).alias("chunk"),
        row.bitwiseAND(63).cast("int").alias("place"),
    )


def _item_counts(sets: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """Rows `(career, itemset, freq)` of single items; those outside the lexicon are dropped."""
    counts = (
        sets.select("career", "w", F.explode("items").alias("item"))
        .groupBy("career", "item")
        .agg(F.sum("w").alias("freq"))
    )
    if lexicon is not None:
        known = lexicon.select(F.lower("skill").alias("item")).distinct()
        counts = counts.join(known, "item", "left_semi")
    return counts.select("career", F.array("item").alias("itemset"), "freq")


def _min_count(n: Column, halvings: Column) -> Column:
    return F.ceil(n / F.pow(F.lit(2.0), halvings)).cast("long")


def _halvings_needed(n: Column, freq: Column) -> Column:
    """Fewest halvings at which an itemset of this count is frequent."""
    guess = F.greatest(F.lit(1), F.ceil(F.log2(n / freq)).cast("int"))
    # Floating logarithms may be off by one near powers of two: settle by the definition.
    return (
        F.when(_min_count(n, guess - 1) <= freq, F.greatest(F.lit(1), guess - 1))
        .when(_min_count(n, guess) <= freq, guess)
        .otherwise(guess + 1)
    )


def _first_reaching(itemsets: DataFrame, careers: DataFrame, need: int) -> DataFrame:
    """Rows `(career, first)`: the first halving from `low` on with `need` frequent itemsets.

    Dealt by career once: there are hardly more itemsets of one than are needed.
    """
    per_step = (
        itemsets.select("career", "freq")
        .repartition("career")
        .join(careers.select("career", "n", "low"), "career")
        .groupBy(
            "career",
            F.greatest("low", _halvings_needed(F.col("n"), F.col("freq"))).alias("halvings"),
        )
        .agg(F.count("*").alias("m"))
    )
    # At most one row per halving, so these groups have some sixty rows.
    so_far = F.sum("m").over(
        W.partitionBy("career").orderBy("halvings").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        per_step.withColumn("m", so_far)
        .where(F.col("m") >= need)
        .groupBy("career")
        .agg(F.min("halvings").alias("first"))
    )


def _tighten(itemsets: DataFrame, careers: DataFrame, enough: int) -> DataFrame:
    """Lower `high` to the first halving that already has enough itemsets.

    The halvings are written first: these tables are so small that all their steps would else
    run in one task, which holds some pages of memory for each.
    """
    return (
        careers.join(cut(_first_reaching(itemsets, careers, enough)), "career", "left")
        .withColumn("done", F.col("first") <= F.col("high"))
        .withColumn("done", F.coalesce("done", F.lit(False)))
        .withColumn("high", F.when(F.col("done"), F.col("first")).otherwise(F.col("high")))
        .drop("first")
    )


def _frequent(counts: DataFrame, careers: DataFrame) -> DataFrame:
    floor = careers.select("career", _min_count(F.col("n"), F.col("high")).alias("floor"))
    return counts.join(floor, "career").where(F.col("freq") >= F.col("floor")).drop("floor")


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _each_pair(rows: DataFrame, kept: list[str], column: str) -> DataFrame:
    """Every two entries `a`, `b` of an array column, in its order; one generated loop per row."""
    first = rows.select(*kept, column, F.posexplode(column).alias("i", "a"))
    later = F.slice(column, F.col("i") + 2, F.size(column))
    return first.select(*kept, "a", F.explode(later).alias("b"))


def _pairs(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Rows `(*_CHUNK, itemset, bits)` of all pairs of the given items that stand in a set together."""
    allowed = items.groupBy("career").agg(F.collect_list(F.col("itemset")[0]).alias("allowed"))
    highest = F.floor(F.log2("w")).cast("int") + 1
    digits = F.filter(F.sequence(F.lit(0), highest), lambda b: F.getbit(F.col("w"), b) == 1)
    reduced = sets.join(allowed, "career").select(
        "career", "chunk", "place", "w", F.array_intersect("items", "allowed").alias("items")
    )
    bit = F.expr("shiftleft(1L, place)")
    return (
        _each_pair(
            reduced.select("career", F.explode(digits).alias("digit"), "chunk", "place", "items"),
            [*_CHUNK, "place"],
            "items",
        )
        .groupBy(*_CHUNK, "a", "b")
        .agg(F.bit_or(bit).alias("bits"))
        .select(*_CHUNK, F.array("a", "b").alias("itemset"), "bits")
    )


def _extended(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """The same one item longer: every two frequent itemsets of a projection, intersected."""
    prefix = F.slice("itemset", F.lit(1), F.size("itemset") - 1)
    projections = (
        found.join(frequent.select("career", "itemset"), ["career", "itemset"], "left_semi")
        .groupBy(*_CHUNK, prefix.alias("prefix"))
        .agg(F.array_sort(F.collect_list(F.struct(F.element_at("itemset", -1).alias("item"), "bits"))).alias("ends"))
        .where(F.size("ends") > 1)
    )
    return (
        _each_pair(projections, [*_CHUNK, "prefix"], "ends")
        .select(*_CHUNK, "prefix", "a", "b", F.col("a.bits").bitwiseAND(F.col("b.bits")).alias("bits"))
        .where("bits <> 0")
        .select(*_CHUNK, F.concat("prefix", F.array("a.item", "b.item")).alias("itemset"), "bits")
    )


def _counted(found: DataFrame) -> DataFrame:
    """Rows `(career, itemset, freq)`; bits are added up before they are shuffled."""
    times = F.expr("shiftleft(cast(bit_count(bits) as bigint), digit)")
    return found.groupBy("career", "itemset").agg(F.sum(times).alias("freq"))


def frequent_itemsets(
    listings: DataFrame,
    lexicon: DataFrame | None = None,
    enough: int = ENOUGH_ITEMSETS,
    min_listings: int = MIN_LISTINGS,
    max_size: int | None = None,
) -> DataFrame:
    """Rows `(career, itemset, freq, n, halvings)` at each career's final support.

    Careers with more than `min_listings` listings are mined. Halving ends when a
    career has `enough` itemsets or support has reached a single listing.
    """
    sets = cut(_numbered(transactions(listings)))
    last = F.greatest(F.lit(1), F.ceil(F.log2("n")).cast("int"))
    # Read in every pass: written, the sets are counted once.
    careers = cut(
        sets.groupBy("career")
        .agg(F.sum("w").alias("n"))
        .where(F.col("n") > min_listings)
        .select("career", "n", last.alias("last"), F.lit(1).alias("low"))
    )
    items = cut(
        _item_counts(sets, lexicon).join(careers.select("career"), "career", "left_semi")
    )
    # First halving at which the frequent items could have enough subsets at all.
    could = cut(_first_reaching(items, careers, math.ceil(math.log2(enough + 1))))
    waiting = careers.join(could, "career", "left").select(
        "career", "n", "last", F.coalesce("first", "last").alias("low")
    )
    mined = None
    while True:
        # Each pass mines the careers still short of itemsets, a few halvings further.
        start = cut(
            waiting.withColumn("high", F.least(F.col("last"), F.col("low") + F.lit(_LOOK_AHEAD)))
        )
        levels = [items]
        # The careers table is small and read many times over: written, plans stay short.
        active = cut(_tighten(items, start, enough))
        found = None
        while max_size is None or len(levels) < max_size:
            longer = (
                _pairs(sets, _frequent(items, active))
                if found is None
                else _extended(found, _frequent(levels[-1], active))
            )
            found, rows = cut_counted(longer)
            if rows:
                level, rows = cut_counted(_frequent(_counted(found), active))
            if rows == 0:
                break
            levels.append(level)
            active = cut(_tighten(_union(levels), start, enough))
        ended = active.where(F.col("done") | (F.col("high") >= F.col("last")))
        found = _frequent(_union(levels), ended).join(
            ended.select("career", "n", F.col("high").alias("halvings")), "career"
        )
        mined = found if mined is None else mined.unionByName(found)
        waiting, rows = cut_counted(
            active.where(~F.col("done") & (F.col("high") < F.col("last"))).select(
                "career", "n", "last", (F.col("high") + 1).alias("low")
            )
        )
        if rows == 0:
            return mined


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules with one suggested skill, as `RULES` rows, from `(career, itemset, freq)`."""
    whole = (
        itemsets.where(F.size("itemset") > 1)
        .select("career", "itemset", "freq", F.explode("itemset").alias("suggested"))
        .withColumn("antecedent", F.array_except("itemset", F.array("suggested")))
    )
    base = itemsets.select(
        "career", F.col("itemset").alias("antecedent"), F.col("freq").alias("base")
    )
    return (
        whole.join(base, ["career", "antecedent"])
        .withColumn("confidence", F.col("freq") / F.col("base"))
        .where(F.col("confidence") >= min_confidence)
        .select(
            "career",
            "antecedent",
            "suggested",
            "confidence",
            F.size("antecedent").alias("complexity"),
            rule_id(F.col("career"), F.col("suggested"), F.col("antecedent")).alias("rule_id"),
        )
    )


def rule_id(career: Column, suggested: Column, antecedent: Column) -> Column:
    """Key of a rule; its skills are sorted, so one rule has one key."""
    return F.concat(career, F.lit("+"), suggested, F.to_json(antecedent))


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Most specific, then most confident rules first."""
    return rules.orderBy(F.desc("complexity"), F.desc("confidence"), "rule_id")


def ranked_rules(rules: DataFrame) -> DataFrame:
    """The same order inside each career, as `rank`."""
    order = [F.desc("complexity"), F.desc("confidence"), "rule_id"]
    return rules.withColumn("rank", F.row_number().over(W.partitionBy("career").orderBy(*order)))

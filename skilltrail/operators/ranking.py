"""Top-k documents per user by cosine or Jaccard similarity.

Every user gets k documents, those without a common skill included (similarity 0, in
key order). They are taken from the first k documents by key, so no user is ever
crossed with the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Similarities are compared and reported at this precision; ties go by document key.
DIGITS = 6


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group with their `rank`.

    The limit on row_number lets Spark prune before the shuffle, so a group never
    sends more than k rows per map task.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_with_zeros(
    scored: DataFrame, owners: DataFrame, fillers: DataFrame, owner: list[str], doc: str, k: int
) -> DataFrame:
    """Top k per owner; `fillers` holds `(*scope, doc)` with at most k rows per scope.

    The scope columns are those that owners and fillers share; with none, all owners
    share one set of fillers.
    """
    best = (
        top_k(scored.where("sim > 0"), owner, [F.desc("sim"), F.col(doc)], k)
        .groupBy(*owner)
        .agg(F.array_sort(F.collect_list(F.struct("rank", doc, "sim"))).alias("best"))
    )
    scope = [c for c in fillers.columns if c != doc]
    lists = fillers.groupBy(*scope).agg(F.array_sort(F.collect_list(doc)).alias("fill"))
    if scope:
        offered = owners.join(lists, scope)
    else:
        offered = owners.withColumn("fill", lists.select("fill").scalar())
    row = f"struct<{doc}:string,sim:double>"
    found = F.coalesce(
        F.transform("best", lambda b: F.struct(b[doc].alias(doc), b["sim"].alias("sim"))),
        F.array().cast(f"array<{row}>"),
    )
    unused = F.array_except("fill", F.transform("found", lambda f: f[doc]))
    zeros = F.transform(
        F.slice(unused, F.lit(1), F.greatest(F.lit(k) - F.size("found"), F.lit(0))),
        lambda d: F.struct(d.alias(doc), F.lit(0.0).alias("sim")),
    )
    return (
        offered.join(best, owner, "left")
        .withColumn("found", found)
        .select(*owner, F.posexplode(F.concat("found", zeros)).alias("pos", "row"))
        .select(*owner, f"row.{doc}", "row.sim", (F.col("pos") + 1).alias("rank"))
    )

"""URL filter: rules by host and path, then a ratio of character language models.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give
each URL's log-likelihoods; their difference per character, calibrated, decides where no rule
does. Exact counts of contexts are kept in a Spark table, gathered from all URLs that the rules
decide, and joined with the distinct contexts of the URLs that are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.quality_model import text_bytes
from skilltrail.llm.tokens import text_slices
from skilltrail.session import cut

#: host suffix, path prefix, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Characters of context at most, and bits of a character (a byte or the end).
ORDER, BITS = 5, 9
#: URLs that are scored together.
BLOCK = 20_000
#: Weight of the shorter context's estimate, in characters seen.
SMOOTHING = 2.0
#: Equal-width steps of the score on which the threshold is calibrated.
STEPS = 400
LIMIT = 8.0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(host, F.lit("")), letters, letters.lower())


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and verdict (null without a rule); columns of these names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    rule (host and path together) wins. A null URL or one without `://` has no host and no rule.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "verdict": verdict})


def grams_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every character, it and its context of ORDER characters, as one exact number.

    A character is a byte of the URL or its end; a context never reaches beyond its URL's
    beginning, where it is padded. The lowest bits hold the character, those above it the one
    before, and so on.
    """
    docs, sizes = len(bounds) - 1, np.diff(bounds)
    spread = np.zeros(len(data) + docs * (ORDER + 1) + ORDER, dtype=np.int64)
    owner = np.repeat(np.arange(docs), sizes)
    spread[np.arange(len(data)) + owner * (ORDER + 1) + ORDER] = data.astype(np.int64) + 1
    at = np.arange(len(data) + docs) + np.repeat(np.arange(docs), sizes + 1) * ORDER + ORDER
    found = np.zeros(len(at), dtype=np.int64)
    for back in range(ORDER + 1):
        found |= spread[at - back] << (BITS * back)
    return found


def _levels(gram: Column) -> Column:
    """The places of a gram in the counts: for each order its context, and both together.

    Level 2 * order is that of contexts, the one above it that of contexts with a character.
    """
    low = lambda x, n: x.bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long"))
    above = F.shiftright(gram, BITS)
    keys = [key for order in range(ORDER + 1) for key in (low(above, order), low(gram, order + 1))]
    return F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in enumerate(keys)])


class RatioModel:
    """Exact counts of both classes (level, key, n0, n1), a table, and the scores they give."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.threshold = 0.0

    def ratios(self, grams: DataFrame) -> DataFrame:
        """Adds to distinct grams (gram) the difference of their log-likelihoods, as ratio."""
        asked = grams.select("gram", F.explode(_levels(F.col("gram"))).alias("at")).select("gram", "at.level", "at.key")
        # Contexts of no or one character are few for any input, and each is that of many grams.
        few = asked.where("level <= 2").join(F.broadcast(self.counts.where("level <= 2")), ["level", "key"])
        many = asked.where("level > 2").join(self.counts.where("level > 2"), ["level", "key"])
        seen = lambda level, kind: F.coalesce(F.max(F.when(F.col("level") == level, F.col(kind))), F.lit(0))
        levels = range(2 * ORDER + 2)
        rows = few.unionByName(many).groupBy("gram").agg(
            *[seen(level, kind).alias(f"{kind}_{level}") for kind in ("n0", "n1") for level in levels]
        )
        logs = []
        for kind in ("n0", "n1"):
            p = F.lit(1 / 257)
            for order in range(ORDER + 1):
                both, context = F.col(f"{kind}_{2 * order + 1}"), F.col(f"{kind}_{2 * order}")
                rows = rows.withColumn(f"p_{kind}_{order}", (both + F.lit(SMOOTHING) * p) / (context + F.lit(SMOOTHING)))
                p = F.col(f"p_{kind}_{order}")
            logs.append(F.log(p))
        return rows.select("gram", (logs[0] - logs[1]).alias("ratio"))

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-likelihood of accepted less that of rejected, per character (the end is one)."""
        if len(bounds) < 2:
            return np.zeros(0)
        found = grams_of(data, bounds)
        spark = self.counts.sparkSession
        asked = spark.createDataFrame([(g,) for g in np.unique(found).tolist()], "gram long")
        return _averages(found, bounds, *_sorted(self.ratios(asked).toArrow()))


def _sorted(ratios: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grams, values = ratios["gram"].to_numpy(), ratios["ratio"].to_numpy()
    order = np.argsort(grams)
    return grams[order], values[order]


def _averages(found: np.ndarray, bounds: np.ndarray, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The average ratio of each URL's grams; one without any count has none."""
    if not len(grams):
        return np.zeros(len(bounds) - 1)
    ends = bounds + np.arange(len(bounds))
    place = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
    each = np.where(grams[place] == found, values[place], 0.0)
    return np.add.reduceat(each, ends[:-1]) / np.diff(ends)


def fitted(labelled: DataFrame) -> RatioModel:
    """A model of the distinct URLs of `labelled` (url, accepted), and its calibrated threshold.

    All contexts of all URLs are counted exactly, in a table that grows with them; tasks add up
    what they see before it is dealt out. The threshold is the step of the score at which both
    classes err equally often, counted over all of them in STEPS steps. With URLs of only one
    class, or none, every URL is accepted.
    """
    urls = cut(labelled.where(F.col("url").isNotNull() & F.col("accepted").isNotNull()).select("url", "accepted").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 0, 1 << 20):
                data, bounds = text_bytes(batch.column(0))
                grams, place = np.unique(grams_of(data, bounds), return_inverse=True)
                kind = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(bounds) + 1)
                n0, n1 = (np.bincount(place[k], minlength=len(grams)) for k in (kind, ~kind))
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n0), pa.array(n1)], names=["gram", "n0", "n1"])

    sums = F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    whole = urls.select("url", "accepted").mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(*sums)
    counts = (
        whole.select(F.explode(_levels(F.col("gram"))).alias("at"), "n0", "n1")
        .groupBy("at.level", "at.key")
        .agg(*sums)
    )
    model = RatioModel(cut(counts))
    steps = F.floor((F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) + LIMIT) / (2 * LIMIT) * STEPS)
    shares = scored(urls, model).groupBy(F.least(steps, F.lit(STEPS - 1)).alias("step"), "accepted").count().collect()
    tally = np.zeros((2, STEPS))
    for row in shares:
        tally[int(row["accepted"]), row["step"]] += row["count"]
    if tally.sum(axis=1).min() == 0:
        model.threshold = -np.inf
    else:
        tally /= tally.sum(axis=1, keepdims=True)
        lost = np.concatenate([[0], np.cumsum(tally[1])])  # accepted below the step
        passed = 1 - np.concatenate([[0], np.cumsum(tally[0])])  # rejected from it on
        best = np.abs(lost - passed) + (lost + passed)
        # In the middle of the best steps, as far from either class as can be.
        good = np.flatnonzero(best <= best.min() + 1e-12)
        model.threshold = float(good.mean()) / STEPS * 2 * LIMIT - LIMIT
    return model


def scored(rows: DataFrame, model: RatioModel) -> DataFrame:
    """Adds score to every row, from its url; a null url scores as an empty one."""
    rows = rows.drop("score")
    urls = rows.select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    # URLs in blocks: a context is looked up once for all URLs of a block.
    blocks = max(1, -(-urls.count() // BLOCK))
    urls = cut(urls.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 0, 1 << 20):
                data, bounds = text_bytes(batch.column(0))
                block = np.repeat(batch.column(1).to_numpy(), np.diff(bounds) + 1)
                grams = grams_of(data, bounds)
                order = np.lexsort((grams, block))
                grams, block = grams[order], block[order]
                new = np.ones(len(grams), dtype=bool)
                new[1:] = (np.diff(grams) != 0) | (np.diff(block) != 0)
                yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(grams[new])], names=["block", "gram"])

    def average(some: pa.Table, ratios: pa.Table) -> pa.Table:
        data, bounds = text_bytes(some["url"].combine_chunks())
        found = _averages(grams_of(data, bounds), bounds, *_sorted(ratios))
        return pa.table({"url": some["url"], "score": pa.array(found)})

    asked = cut(urls.mapInArrow(distinct, "block long, gram long").distinct())
    ratios = asked.join(model.ratios(asked.select("gram").distinct()), "gram").select("block", "gram", "ratio")
    found = urls.groupBy("block").cogroup(ratios.groupBy("block")).applyInArrow(average, "url string, score double")
    found = cut(found).withColumnRenamed("url", "_url")
    return rows.join(found, F.coalesce(rows["url"], F.lit("")) == F.col("_url"), "left").drop("_url")


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every row with host, path, rule, score and verdict (allow or block).

    Where a rule fits, it decides; elsewhere the models, which are fitted on the URLs that rules
    decide. An empty or null url is allowed unless the models say otherwise. Columns of these
    names are replaced; equal rows are judged alike; an empty table stays empty.
    """
    ruled = with_rules(pages, rules)
    known = ruled.where(F.col("verdict").isNotNull())
    model = fitted(known.select("url", (F.col("verdict") == "allow").alias("accepted")))
    says = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return scored(ruled, model).withColumn("verdict", F.coalesce("verdict", says))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filtered(pages).select("page_id", "host", "path", "rule", "verdict", "score")

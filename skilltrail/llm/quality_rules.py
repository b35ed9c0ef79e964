"""Quality rules by host: failures per domain, shrunk rates, verdicts joined back.

Each document is measured and tested by base rules; failures are added up per host, a
host's rate is shrunk towards the common rate with a beta prior fitted to all hosts, and
documents of hosts whose shrunk rate is too high go, too. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.session import cut

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes when its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.75

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    All count in the whole text; a null text has no words. Columns of these names are
    replaced. Windows are compared by the 64-bit hash of their words' hashes; only texts in
    which a hash occurs twice pay for finding the places.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    windows = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_windows = F.when(
        repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    starts = F.array_sort(
        F.transform(
            F.filter(
                "_sorted",
                lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        docs.withColumn("_words", F.array_remove(F.split(text, _SPACE + "+"), ""))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(_SYMBOL)).cast("long"),
                "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            }
        )
        .withColumn("_windows", windows)
        .withColumn("_sorted", sorted_windows)
        .withColumn("_starts", starts)
        .withColumn("n_repeat_words", covered)
        .withColumn("base_failed", failed)
        .drop("_words", "_hashes", "_windows", "_sorted", "_starts")
    )


def host_rates(table: DataFrame, host: str = "source") -> DataFrame:
    """host, documents, failures and host_rate (shrunk) of every host but null.

    The beta prior has the common rate as mean; its weight follows by moments from how much
    the hosts' rates vary beyond chance, and lies between 1 and 10**6 documents.
    """
    hosts = (
        table.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("_host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    )
    sums = hosts.agg(
        F.sum("n").alias("docs"),
        F.sum("failures").alias("failed"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"),
    )
    mean = F.col("failed") / F.col("docs")
    chance = F.col("mean") * (1 - F.col("mean"))
    beyond = F.col("squares") / F.col("docs") - F.col("mean") ** 2 - chance * F.col("hosts") / F.col("docs")
    weight = F.when(chance == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1e6), F.greatest(F.lit(1.0), chance / F.greatest(F.col("beyond"), F.lit(1e-9)) - 1))
    )
    prior = (
        sums.where("docs > 0")
        .withColumn("mean", mean)
        .withColumn("beyond", beyond)
        .select("mean", weight.alias("weight"))
    )
    # The prior is one row.
    return hosts.join(F.broadcast(prior)).select(
        "_host",
        "n",
        "failures",
        ((F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias(
            "host_rate"
        ),
    )


def judged(table: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Adds host_rate and kept to measured rows; columns of these names are replaced.

    Kept are rows that pass the base rules and whose host's shrunk failure rate is at most
    `max_rate`. A row without host is judged by the base rules alone. Equal rows are judged
    alike; an empty table stays empty. Failures are added up before the shuffle, so a host
    with any share of the rows is one number per task; hosts that are too many to broadcast
    are joined with skew splitting.
    """
    rates = host_rates(table, host).select("_host", "host_rate")
    good = F.coalesce(F.col("host_rate") <= max_rate, F.lit(True))
    table = table.drop("host_rate")
    return (
        table.join(rates, F.col(host) == F.col("_host"), "left")
        .withColumn("kept", ~F.col("base_failed") & good)
        .drop("_host")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; its source is its host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = cut(measured(docs.select("doc_id", "text", "source")).drop("text"))
    return judged(table).select("doc_id", *MEASURES, "base_failed", "kept")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, i - coalesce(p, i - 8))) AS n FROM starts GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])
          - len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')])))::BIGINT
           AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source AS host, count(*) AS n, sum(base_failed::BIGINT) AS f
          FROM failed WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS docs, sum(f) / sum(n) AS m, count(*) AS h, sum(f * f / n) / sum(n) AS sq FROM hosts),
prior AS (SELECT m, CASE WHEN m * (1 - m) = 0 THEN 1.0 ELSE
            least(1e6, greatest(1.0, m * (1 - m) / greatest(sq - m * m - m * (1 - m) * h / docs, 1e-9) - 1)) END AS k
          FROM sums),
rates AS (SELECT host, (f + m * k) / (n + k) AS r FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r <= 0.75, true) AS kept
FROM failed LEFT JOIN rates ON source = host
"""

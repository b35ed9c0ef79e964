"""The driver's tables in the roles of listings, users, skills and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.functions.text import WORD_CLASS, format_career, format_skill, url_key, word_tokens
from skilltrail.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Orders as listings: career = customer segment, skills = brands ordered.


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bags = (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        .groupBy("l_orderkey")
        .agg(F.collect_list("p_brand").alias("skills"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        bags.join(orders, bags["l_orderkey"] == orders["o_orderkey"])
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            format_career(F.col("c_mktsegment")).alias("career"),
            F.col("o_orderkey").cast("string").alias("unique_url"),
            "skills",
            F.col("o_custkey").alias("user_id"),
            "o_orderdate",
            "o_orderkey",
        )
    )


def brand_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("skill"))
        .agg(F.min("p_partkey").alias("ord"))
        .select("skill", format_skill(F.col("skill")).alias("formatted"), "ord")
    )


def customers_as_users(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests `(user_id, career)` and skills: each customer's latest order."""
    latest = listings.groupBy("user_id", "career").agg(
        F.max_by("skills", F.struct("o_orderdate", "o_orderkey")).alias("skills")
    )
    return (
        latest.select("user_id", "career"),
        latest.select("user_id", F.explode("skills").alias("skill")).distinct(),
    )


# Documents as listings: career = source, skills = words. Benchmark passages as users.


def document_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        F.col("source").alias("career"),
        F.col("doc_id").cast("string").alias("unique_url"),
        word_tokens(F.col("text")).alias("skills"),
    )


def passage_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("user_id"), F.explode(word_tokens(F.col("text"))).alias("skill")
    )


# Words and word pairs of the passages as skill dictionary.


def passage_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(
        "item_id", word_tokens(F.col("text")).alias("w")
    )
    phrases = F.transform(
        "w",
        lambda word, i: F.struct(
            i.cast("long").alias("pos"),
            F.array_distinct(
                F.array(word, F.concat_ws(" ", word, F.get(F.col("w"), i + 1)))
            ).alias("phrases"),
        ),
    )
    return (
        words.select("item_id", F.inline(phrases))
        .select(
            (F.shiftleft("item_id", 32) + F.col("pos")).alias("ord"),
            F.explode("phrases").alias("skill"),
        )
        .groupBy("skill")
        .agg(F.min("ord").alias("ord"))
        .select("skill", format_skill(F.col("skill")).alias("formatted"), "ord")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def page_arrivals(frame: DataFrame) -> DataFrame:
    """Pages as a crawl: what is under a URL, in page order."""
    return frame.select(
        url_key(F.col("url")).alias("unique_url"),
        "page_id",
        F.col("url").startswith("http://").alias("crawled_before"),
    )


# Chat words as suggestions: users propose skills, assistants report them.


def chat_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_words(table(spark, sf_dir, "conversations"))


def part_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line suggests its part's name and brand as a career."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("add_career").alias("action"),
        F.concat_ws(" ", "p_name", "p_brand").alias("suggestion"),
    )


def skill_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as add / remove log: errors remove the skill of their key."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("skill"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
        "ts",
        "event_id",
    )


def texts_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def crawl_pages(frame: DataFrame) -> DataFrame:
    """Pages as saved listings: career = language in the URL, crawled in page order."""
    return frame.select(
        "page_id",
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("career"),
        F.timestamp_seconds("page_id").alias("searched_at"),
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.lit("").alias("location"),
        url_key(F.col("url")).alias("unique_url"),
        "html",
    )


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table, a file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    # A plain path would have to be a folder; a pattern may also name a single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def chat_words(chats: DataFrame) -> DataFrame:
    """Chat rows as suggestions `(action, suggestion, ts)`: one per word."""
    action = (
        F.when(F.col("role") == "user", "add_skill")
        .when(F.col("role") == "assistant", "remove_skill")
        .otherwise("add_career")
    )
    words = F.regexp_extract_all("text", F.lit(f"([{WORD_CLASS}]+)"), 1)
    said = chats.select(
        "conv_id", "turn", action.alias("action"), F.posexplode_outer(words).alias("pos", "suggestion")
    ).where(F.col("suggestion").isNotNull())
    moment: Column = F.timestamp_seconds(
        F.col("conv_id") * 10_000_000 + F.col("turn") * 100_000 + F.col("pos")
    )
    return said.select("action", "suggestion", moment.alias("ts"))

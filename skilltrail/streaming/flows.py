"""Streams of arriving pages and suggestions, equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import career_feedback, fold_spellings, spelling_counts
from ..plans.jobs import ingest_pages
from ..session import cut, spread

#: Folders that running counts are dealt to; fixed for the life of a stream.
BUCKETS = 32

SPELLINGS = "action string, formatted string, spelling string, n long, last_ts timestamp"
CAREERS = "career string, n long"

# One run over what has arrived; pass e.g. {"processingTime": "1 minute"} to keep running.
ONCE = {"availableNow": True}


def ingest_stream(
    pages: DataFrame,
    lexicon: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict = ONCE,
    copies_within: str = "1 hour",
) -> StreamingQuery:
    """Add arriving pages to the listing table, one row per URL over all batches.

    A page that arrives once more, equal in all columns, within `copies_within` is dropped by
    the stream's own state, before anything is extracted or looked up. The time is that of
    arrival, so no page is ever too late. Other copies of a URL reach the insert, which takes the
    first one of a batch and skips the keys already stored: which copy stays does not depend on
    the order inside a batch, and a batch that is run again inserts only what is missing. One
    writer per table.
    """
    marked = pages.select(
        F.struct(*pages.columns).alias("page"),
        "unique_url",
        F.xxhash64(*pages.columns).alias("digest"),
        F.hash(*pages.columns).alias("check"),
        F.current_timestamp().alias("arrived"),
    )
    fresh = (
        marked.withWatermark("arrived", copies_within)
        .dropDuplicatesWithinWatermark(["unique_url", "digest", "check"])
        .select("page.*")
    )

    def insert(batch: DataFrame, _: int) -> None:
        ingest_pages(spread(batch), lexicon, path)

    return (
        fresh.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The batches that each bucket of the counts was written by, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if files.exists(folder):
        for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts/bucket=*/batch=*")):
            name = status.getPath()
            bucket = int(name.getParent().getName().rpartition("=")[2])
            found.setdefault(bucket, []).append(int(name.getName().rpartition("=")[2]))
    return {bucket: sorted(batches) for bucket, batches in found.items()}


def _folders(path: str, versions: dict[int, list[int]]) -> list[str]:
    return [f"{path}/counts/bucket={b}/batch={n}" for b, numbers in versions.items() for n in numbers]


def _counting(counts: DataFrame, keys: list[str], path: str, trigger: dict) -> StreamingQuery:
    """Keep a snapshot of running counts in `path`, next to the stream's own state.

    Only counts that changed leave a batch, as new totals. Keys are dealt to buckets by hash; a
    batch rewrites the buckets it touches, from their last version before it, into folders of
    its own number, so that repeating it writes the same again. Versions before the last two
    of a bucket are removed. State and snapshots share a folder, so batch numbers never mix.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = cut(batch.withColumn("bucket", bucket))
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]
        if not touched:
            return
        versions = _versions(spark, path)
        earlier = {b: [n for n in versions.get(b, []) if n < number] for b in touched}
        before = {b: numbers[-1:] for b, numbers in earlier.items() if numbers}
        merged = changed
        if before:
            old = spark.read.schema(batch.schema).parquet(*_folders(path, before))
            again = changed.select(F.struct(*keys).alias("again"))
            kept = old.join(again, F.struct(*keys).eqNullSafe(F.col("again")), "left_anti")
            merged = changed.unionByName(kept.withColumn("bucket", bucket))
        (
            merged.withColumn("batch", F.lit(number).cast("long"))
            .repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch")
            .parquet(f"{path}/counts")
        )
        _remove_old(spark, path, touched)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(**trigger)
        .start()
    )


def _remove_old(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Remove all but the last two versions of the given buckets."""
    found = _versions(spark, path)
    for name in _folders(path, {b: found[b][:-2] for b in buckets if b in found}):
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version of every bucket; folder names alone tell it."""
    newest = {b: numbers[-1:] for b, numbers in _versions(spark, path).items()}
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_folders(path, newest))


def feedback_stream(suggestions: DataFrame, path: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keep running counts of suggested skills; `read_feedback` reads them."""
    keys = ["action", "formatted", "spelling"]
    return _counting(spelling_counts(suggestions), keys, path, trigger)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Skill counters as of the last batch."""
    return fold_spellings(_latest(spark, path, SPELLINGS))


def career_stream(suggestions: DataFrame, path: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keep running counts of suggested careers; `read_careers` reads them."""
    return _counting(career_feedback(suggestions), ["career"], path, trigger)


def read_careers(spark: SparkSession, path: str) -> DataFrame:
    """Career counters as of the last batch."""
    return _latest(spark, path, CAREERS)

"""An index of the URLs of a listing table, so that an insert reads only keys it may meet.

The index lies in the table's folder under `_keys`, which readers of the table skip:

- `urls/bucket=B`: `(h, unique_url)` of every listing, dealt by hash; `h` has a Parquet Bloom filter
- `files`: the data files whose keys are in it

The table alone is the truth. An insert first adds the keys of data files that the index does not
name yet (those of the last insert, or of a writer that broke off), and then looks its own keys
up. Keys written twice by a repeated run do no harm, as only their presence counts.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders the keys are dealt to; fixed for the life of an index.
BUCKETS = 64
#: Hashes of a batch that are given to the Parquet reader to skip row groups by their Bloom
#: filters; a larger batch is told apart by its buckets alone.
LOOKED_UP = 100

_FILES = "name string"


def bucket_of(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _names(paths: list[str]) -> dict[str, str]:
    """Files by their name below the table: the career's folder and the file's own name."""
    return {"/".join(p.rsplit("/", 2)[1:]): p for p in map(unquote, paths)}


def index_new_files(stored: DataFrame, path: str) -> int:
    """Add the keys of data files that are not in the index yet; returns how many there were."""
    spark = stored.sparkSession
    folder = f"{path.rstrip('/')}/_keys"
    present = _names(stored.inputFiles())
    known = set()
    if "files" in _children(spark, folder):
        known = {r["name"] for r in spark.read.schema(_FILES).parquet(f"{folder}/files").collect()}
    fresh = sorted(present.keys() - known)
    if not fresh:
        return 0
    rows = stored
    if known:
        reader = spark.read.schema(stored.schema).option("basePath", path)
        rows = reader.parquet(*(present[name] for name in fresh))
    h = F.xxhash64("unique_url")
    (
        rows.select(h.alias("h"), "unique_url", bucket_of(h).alias("bucket"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "h")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#h", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy("bucket")
        .parquet(f"{folder}/urls")
    )
    # Named only now: a run that breaks off before this writes the same keys again.
    spark.createDataFrame([(name,) for name in fresh], _FILES).coalesce(1).write.mode("append").parquet(
        f"{folder}/files"
    )
    return len(fresh)


def stored_keys(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Rows `(unique_url)` of the index that the given keys may meet.

    Only the keys' buckets are read, and of these, for a small batch, only row groups whose Bloom
    filter has one of its hashes. At most `LOOKED_UP` hashes come to the driver.
    """
    hashes = keys.select(F.xxhash64("unique_url").alias("h")).distinct()
    some = [r["h"] for r in hashes.limit(LOOKED_UP + 1).collect()]
    if len(some) <= LOOKED_UP:
        # The reader tests lists of up to ten values one by one, longer ones by their ends.
        listed = F.lit(False)
        for i in range(0, len(some), 10):
            listed = listed | F.col("h").isin(some[i : i + 10])
        touched = {h % BUCKETS for h in some}
    else:
        listed = F.lit(True)
        of = hashes.select(bucket_of(F.col("h")).alias("bucket")).distinct()
        touched = {r["bucket"] for r in of.collect()}
    folder = f"{path.rstrip('/')}/_keys/urls"
    folders = [f"{folder}/{name}" for name in _children(spark, folder) if name in {f"bucket={b}" for b in touched}]
    if not folders:
        return spark.createDataFrame([], "unique_url string")
    return spark.read.schema("h long, unique_url string").parquet(*folders).where(listed).select("unique_url")


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, which need not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

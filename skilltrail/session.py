"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings the operators are planned for. A hot career, skill or URL is
# split by AQE even where that costs one more exchange.
SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; sizes and memory stay with the cluster."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skilltrail")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    return tune(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for lineage cuts: the cluster's shared folder when it names one.

    Only a session that names none (a local test) falls back to a temporary folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if shared:
        if current is None:
            context.setCheckpointDir(shared)
        return shared
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="skilltrail-checkpoint-")
        context.setCheckpointDir(current)
    return current


# Names of the open scopes, outermost first.
_scopes: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, below one folder per application and open scope.

    Nothing is deleted while the application may still read it: a scope removes its folder
    when it ends, the rest is removed with the application's folder.
    """
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    inside = "/".join([spark.sparkContext.applicationId, *_scopes])
    return f"{folder}/skilltrail/{inside}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove, at the end, all intermediate tables that were cut inside.

    Results have to be written before the scope ends; frames made inside it cannot be read
    afterwards.
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = scratch_path(spark, "x").rpartition("/")[0]
    try:
        yield
    finally:
        _scopes.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage here: write a table to the checkpoint folder and read it back.

    Unlike cached blocks the table survives the loss of any executor, and unlike an RDD
    checkpoint it is columnar and tells the optimizer its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, with the number of rows counted while writing."""
    counter = Observation()
    table = cut(df.observe(counter, F.count(F.lit(1)).alias("rows")))
    return table, counter.get["rows"]


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores; larger inputs stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Token files: Parquet list columns in ascending document order, with selective reads.

The ids of every document are written as one list column next to its number, its count
and its place, dictionary-encoded (delta-encoded where a dictionary does not pay), in
row groups and pages of chosen size with page indexes. Counts and places can be read
without touching the ids, and a range of documents without reading other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltrail.llm.tokens import encoder, public_path, text_slices, with_end
from skilltrail.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"

def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 128 << 10,
    codec: str = "snappy",
) -> None:
    """Write the ids of every document, each closed by `end_id`, in ascending `doc_id` order.

    `docs` needs `doc_id` and `text`; other columns are ignored. A null or empty text gives
    the end id alone. Rows with one doc_id are ordered by their text; equal rows are all
    written. A null doc_id comes first. An empty table gives files without rows.

    Documents are dealt to tasks by ranges of doc_id, so the only exchange is that of the
    texts; a task numbers its ids as it writes them.
    """
    name = vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(name or public_path(VOCABULARY), True)
        part = TaskContext.get().partitionId()
        start = 0
        for whole in batches:
            for batch in text_slices(whole, 1):
                flat, bounds = with_end(*words.ids_of(batch.column(1)), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(len(batch), part, dtype=np.int32)),
                        pa.array(bounds[:-1] + start),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32))
                        ),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    placed = (
        docs.select(F.col("doc_id").cast("long"), F.col("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    (
        placed.mapInArrow(encode, SCHEMA)
        .write.option("compression", codec)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids.

    Selecting without `ids` reads the small columns only. The table of part offsets has one
    row per file.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            edges = lists.offsets.to_pylist()
            found = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2).cast(pa.int64()),
                    pa.array(found, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        sums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as written to token files and read back."""
    path = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return checksums(read_tokens(spark, path))

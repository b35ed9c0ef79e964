"""Sharding by histogram sort: exact byte counts below probes, refined until splitters fit.

The order is that of the texts' hash, then of doc_id, so equal texts lie side by side. Probes
are prefixes of the key. Each round counts the exact bytes in the cells between probes, on all
partitions; a splitter whose cell boundary misses its target by more than the tolerance gets
finer probes inside that cell, first by hash, then, inside one text, by doc_id. When all
splitters fit, rows are exchanged once. DataFrame operations only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltrail.session import cut

#: The first probes cut the 64-bit hash into 2**12 cells, every further round a cell into 2**8.
FIRST_BITS, STEP_BITS = 12, 8
LOWEST = -(1 << 63)


def _histogram(digest: DataFrame, intervals: list[tuple], inner: str) -> list:
    """Bytes, rows and key range of each cell of the intervals (number, h, old shift, prefix, shift).

    One row per interval and non-empty cell: at most 2**8 for an interval.
    """
    spark = digest.sparkSession
    table = spark.createDataFrame(
        intervals, "number int, of long, old int, prefix long, shift int"
    )
    if inner == "h":
        match = F.expr(f"shiftright(h, {intervals[0][2]})") == F.col("prefix")
    else:
        match = (F.col("h") == F.col("of")) & (F.expr("shiftright(k, old)") == F.col("prefix"))
    return (
        digest.join(F.broadcast(table), match)
        .groupBy("number", F.expr(f"shiftright({inner}, shift)").alias("cell"))
        .agg(
            F.sum("size").alias("bytes"),
            F.min("h").alias("h0"),
            F.max("h").alias("h1"),
            F.min("k").alias("k0"),
            F.max("k").alias("k1"),
        )
        .collect()
    )


def _splitters(digest: DataFrame, total: int, targets: list[tuple[float, float]]) -> list[tuple]:
    """The key (h, k) at which each target (bytes below, tolerance) is met; rows from it on lie above."""
    found: list[tuple | None] = [None] * len(targets)
    first = 64 - FIRST_BITS
    rows = (
        digest.groupBy(F.shiftright("h", first).alias("cell"))
        .agg(
            F.sum("size").alias("bytes"),
            F.min("h").alias("h0"),
            F.max("h").alias("h1"),
            F.min("k").alias("k0"),
            F.max("k").alias("k1"),
        )
        .collect()
    )
    # (kind, h of the text, shift, cells, bytes below the first cell, splitters that fall inside)
    open_cells = [("h", None, first, rows, 0, range(len(targets)))]
    while open_cells:
        asked: dict[tuple, list] = {}
        for kind, text, shift, cells, below, wanted in open_cells:
            cells = sorted(cells, key=lambda r: r["cell"])
            edges, at = [], below
            for cell in cells:
                edges.append(at)
                at += cell["bytes"]
            edges.append(at)
            for j in wanted:
                goal, slack = targets[j]
                i = min(max(bisect_right(edges, goal) - 1, 0), len(cells) - 1)
                low, high, cell = edges[i], edges[i + 1], cells[i]
                if min(goal - low, high - goal) <= slack or (
                    cell["h0"] == cell["h1"] and cell["k0"] == cell["k1"]
                ):
                    side = cell["cell"] + (1 if high - goal < goal - low else 0)
                    bound = side << shift
                    found[j] = (bound, LOWEST) if kind == "h" else (text, min(bound, -LOWEST - 1))
                elif cell["h0"] == cell["h1"]:
                    # One text: on to doc_id, from the highest bits in which its rows differ.
                    if kind == "h" or shift > 0:
                        differ = (cell["k0"] ^ cell["k1"]).bit_length() if cell["k0"] ^ cell["k1"] >= 0 else 64
                        old = min(differ, 63)
                        key = ("k", cell["h0"], old, cell["k0"] >> old, max(0, old - STEP_BITS))
                        asked.setdefault(key, [low, []])[1].append(j)
                else:
                    key = ("h", None, shift, cell["cell"], max(0, shift - STEP_BITS))
                    asked.setdefault(key, [low, []])[1].append(j)
        open_cells = []
        for kind in ("h", "k"):
            # A text whose doc_ids differ in sign has two intervals of 63 bits, hence the second prefix.
            keys = [key for key in asked if key[0] == kind]
            intervals = []
            for n, key in enumerate(keys):
                prefixes = {key[3], -1, 0} if key[2] == 63 else {key[3]}
                intervals += [(n, key[1], key[2], p, key[4]) for p in prefixes]
            if intervals:
                cells: dict[int, list] = {}
                for row in _histogram(digest, intervals, kind):
                    cells.setdefault(row["number"], []).append(row)
                for n, key in enumerate(keys):
                    low, wanted = asked[key]
                    open_cells.append((kind, key[1], key[4], cells[n], low, wanted))
    return found


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    tolerance: float = 0.001,
    part_bytes: int = 32 << 20,
    most_parts: int = 256,
) -> DataFrame:
    """Every row with its shard and its place there; shards are nearly equal in bytes.

    A row weighs the UTF-8 bytes of its text plus 8. A boundary between shards misses its
    target by at most `tolerance` of a shard, or by half the rows that share text and doc_id
    there. Equal texts share a shard unless a boundary has to fall inside their group; a
    group of any size is split by doc_id.

    Adds size, text_crc32, law (`bytes`), shard, slot and grown_shard (null); columns of these
    names are replaced. A null text counts as empty; a null doc_id sorts first. Rows that
    agree in text and doc_id stay together, in any order. An empty table stays empty.

    Large shards are sorted in up to `most_parts` parts of about `part_bytes`, which are cut
    by the same histogram. The driver sees at most 2**12 cells in the first round, then
    2**8 per unresolved splitter.
    """
    keyed = docs.withColumns(
        {
            "size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8,
            "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")),
            "_h": F.xxhash64(F.coalesce("text", F.lit(""))),
            "_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)),
        }
    )
    digest = cut(keyed.select(F.col("_h").alias("h"), F.col("_k").alias("k"), "size"))
    total = digest.agg(F.sum("size")).first()[0] or 0
    parts = min(most_parts, max(1, -(-total // (shards * part_bytes))))
    count = shards * parts
    targets = [
        (total * j / count, total / shards * tolerance if j % parts == 0 else total / count / 4)
        for j in range(1, count)
    ]
    bounds = _splitters(digest, total, targets) if total else []
    outer = [(LOWEST, LOWEST), *bounds[parts - 1 :: parts], (1 << 63, LOWEST)]
    bounds = [
        b if j % parts == 0 else min(max(b, outer[j // parts]), outer[j // parts + 1])
        for j, b in enumerate(bounds, 1)
    ]
    # Splitters below and inside each first cell; 2**12 rows.
    shift, cells = 64 - FIRST_BITS, []
    bounds.sort()
    for cell in range(-(1 << FIRST_BITS - 1), 1 << FIRST_BITS - 1):
        low = bisect_right(bounds, (cell << shift, LOWEST))
        high = bisect_right(bounds, ((cell + 1) << shift, LOWEST - 1))
        cells.append((cell, low, [b for b in bounds[low:high]]))
    spark = docs.sparkSession
    table = F.broadcast(
        spark.createDataFrame(cells, "_cell long, _low int, _inner array<struct<h:long,k:long>>")
    )

    def placed(rows: DataFrame, h: str, k: str) -> DataFrame:
        passed = F.filter(
            "_inner", lambda b: (b["h"] < F.col(h)) | ((b["h"] == F.col(h)) & (b["k"] <= F.col(k)))
        )
        return rows.withColumn("_cell", F.shiftright(h, shift)).join(table, "_cell").withColumn(
            "_part", F.col("_low") + F.size(passed)
        )

    held = {r["_part"]: r["count"] for r in placed(digest, "h", "k").groupBy("_part").count().collect()}
    offsets, at = [], 0
    for part in range(count):
        at = 0 if part % parts == 0 else at
        offsets.append((part, part // parts, at))
        at += held.get(part, 0)
    offset = F.broadcast(spark.createDataFrame(offsets, "_part int, shard int, _offset long"))
    inside = Window.partitionBy("_part").orderBy("_h", "_k")
    return (
        placed(keyed.drop("shard"), "_h", "_k")
        .withColumn("_rank", F.row_number().over(inside))
        .join(offset, "_part")
        .withColumns(
            {
                "law": F.lit("bytes"),
                "slot": F.col("_offset") + F.col("_rank") - 1,
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("_h", "_k", "_cell", "_low", "_inner", "_part", "_rank", "_offset")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

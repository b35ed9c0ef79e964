"""Vector compression by product codes over per-dimension value dictionaries.

Components are small integers, so a block of vectors has few distinct values in a dimension.
A block is stored as one dictionary of distinct values per dimension and two bytes a component
that point into it. To assign parts of vectors to codebook entries, the squared differences
of every distinct value to all entries are tabulated once per block and dimension; the distance
of a part is then a sum of table rows gathered by the codes, exact in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.vectors import LARGEST, matrices, usable
from skilltrail.session import cut

#: Parts of a vector, entries of a part's codebook, rounds of improvement, levels of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components and rows of a block, at most; places in a dictionary fit two bytes.
BLOCK_CELLS, BLOCK_ROWS = 1 << 16, 4096


def block_schema(label_type: str) -> str:
    return f"ids array<long>, labels array<{label_type}>, sizes array<int>, vals array<int>, codes binary"


def dictionaries(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each column, their numbers, and the codes, column after column."""
    values, codes = [], np.empty(grid.shape[::-1], dtype="<u2")
    for d, column in enumerate(grid.T):
        low, high = int(column.min()), int(column.max())
        if high - low < 1 << 16:
            seen = np.zeros(high - low + 1, dtype=bool)
            seen[column - low] = True
            values.append(np.flatnonzero(seen) + low)
            codes[d] = (np.cumsum(seen) - 1)[column - low]
        else:
            distinct, codes[d] = np.unique(column, return_inverse=True)
            values.append(distinct)
    return np.concatenate(values), np.array([len(v) for v in values]), codes


def decoded(sizes: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The block's integers, dimension by dimension."""
    starts = np.cumsum(sizes) - sizes
    return values[codes.astype(np.int64) + starts[:, None]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """ids, labels, sizes, values and codes of each stored block."""
    for batch in batches:
        for i in range(len(batch)):
            ids, labels, sizes, values, codes = (batch.column(c)[i] for c in range(5))
            sizes = sizes.values.to_numpy()
            codes = np.frombuffer(codes.as_buffer(), dtype="<u2").reshape(len(sizes), -1)
            yield ids.values, labels.values, sizes, values.values.to_numpy().astype(np.int64), codes


def assigned(
    sizes: np.ndarray, values: np.ndarray, codes: np.ndarray, books: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower) of every part of a block's rows, and its distance.

    `books` holds the entries of all parts side by side: entries x dimensions.
    """
    parts, rows = PARTS, codes.shape[1]
    width = len(sizes) // parts
    starts = np.cumsum(sizes) - sizes
    reach = max(int(np.abs(values).max()), int(np.abs(books).max())) * 2
    # Narrow numbers where no sum of squares can leave them: the same results, half the memory.
    kind = np.int32 if reach * reach * width < 1 << 31 else np.int64
    nearest = np.empty((parts, rows), dtype=np.uint8)
    errors = np.empty((parts, rows), dtype=np.int64)
    total = np.empty((rows, len(books)), dtype=kind)
    for part in range(parts):
        for j in range(width):
            d = part * width + j
            own = values[starts[d] : starts[d] + sizes[d]].astype(kind)
            table = own[:, None] - books[:, d].astype(kind)
            table *= table
            if j:
                total += table[codes[d]]
            else:
                np.take(table, codes[d], axis=0, out=total)
        best = total.argmin(axis=1)
        nearest[part] = best
        errors[part] = total[np.arange(rows), best]
    return nearest, errors


def stored_blocks(vectors: DataFrame, dims: int, key: str, vector: str, label: str) -> DataFrame:
    """Usable vectors as dictionary-coded blocks, written once for all passes."""
    label_type = vectors.schema[label].dataType
    rows = vectors.select(F.col(vector).cast("array<double>"), F.col(key).cast("long"), label)
    step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // dims))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for columns, grid in matrices(batches, dims, SCALE):
            held.append((*columns, grid))
            count += len(grid)
            if count >= step:
                yield from emit(held)
                held, count = [], 0
        if held:
            yield from emit(held)

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, labels, grids = zip(*held, strict=True)
        ids, labels, grid = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(grids)
        for start in range(0, len(grid), step):
            some = grid[start : start + step]
            values, sizes, codes = dictionaries(some)
            row = [
                _one_list(ids.slice(start, step)),
                _one_list(labels.slice(start, step)),
                _one_list(pa.array(sizes, pa.int32())),
                _one_list(pa.array(values, pa.int32())),
                pa.array([codes.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, names=["ids", "labels", "sizes", "vals", "codes"])

    return cut(rows.mapInArrow(encode, block_schema(label_type.simpleString())))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of the parts assigned to them; unused ones stay.

    A task adds up its own blocks, so that each sends entries x (dimensions + parts) sums; as
    many are brought to the driver, whatever the number of vectors.
    """
    count, dims = books.shape
    width = dims // PARTS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims + PARTS, count), dtype=np.int64)
        for _, _, sizes, values, codes in _blocks(batches):
            nearest, _ = assigned(sizes, values, codes, books)
            grid = decoded(sizes, values, codes)
            for part in range(PARTS):
                sums[dims + part] += np.bincount(nearest[part], minlength=count)
                for d in range(part * width, (part + 1) * width):
                    # Exact: a block's sums stay far below 2**53.
                    sums[d] += np.bincount(nearest[part], weights=grid[d], minlength=count).astype(np.int64)
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums.ravel()[slots])], names=["slot", "total"])

    found = blocks.mapInArrow(tally, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    sums = np.zeros((dims + PARTS) * count, dtype=np.int64)
    for row in found.collect():
        sums[row["slot"]] = row["total"]
    sums = sums.reshape(dims + PARTS, count)
    used = np.repeat(sums[dims:], width, axis=0)
    return np.where(used > 0, sums[:dims] // np.maximum(used, 1), books.T).T.copy()


def trained(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        books = improved(blocks, books)
    return books


def listed(books: np.ndarray) -> str:
    """All entries' components in decimals, by part, entry and place in the part."""
    width = books.shape[1] // PARTS
    by_part = books.reshape(len(books), PARTS, width).transpose(1, 0, 2)
    return ",".join(map(str, by_part.ravel().tolist()))


def coded(blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every stored vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, sizes, values, codes in _blocks(batches):
            nearest, errors = assigned(sizes, values, codes, books)
            digits = nearest.T.tobytes().hex()
            size = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    labels,
                    pa.array([digits[i : i + size] for i in range(0, len(digits), size)], pa.string()),
                    pa.array(errors.sum(axis=0)),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return blocks.mapInArrow(encode, f"vec_id long, label {label_type}, code string, error long")


def compressed(
    vectors: DataFrame,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors (vec_id, label, code, error), and the codebooks.

    Components become floor(256 x); beyond +-2**27 they are set to that. Vectors that are null,
    empty, hold null or non-finite components, or differ in length from the one with the
    smallest id are left out. Vectors are cut into 16 equal parts, so their length has to be a
    multiple of 16 (ValueError otherwise). Codebooks begin as the vectors with the smallest ids
    (null ids last, equal ids in the vectors' order); with fewer vectors they have fewer
    entries, at most 256. Equal rows each get their code. An empty table gives no rows and
    codebooks of no entries. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    label_type = vectors.schema[label].dataType.simpleString()
    rows, dims = usable(vectors, key, vector)
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components cannot be cut into {PARTS} equal parts")
    if not dims:
        empty = vectors.sparkSession.createDataFrame(
            [], f"vec_id long, label {label_type}, code string, error long"
        )
        return empty, np.zeros((0, 0), dtype=np.int64)
    smallest = rows.orderBy(F.asc_nulls_last(key), vector).limit(entries).select(vector).collect()
    start = np.floor(np.array([r[0] for r in smallest], dtype=np.float64) * SCALE)
    books = np.clip(start, -LARGEST, LARGEST).astype(np.int64)
    blocks = stored_blocks(rows, dims, key, vector, label)
    books = trained(blocks, books, rounds)
    return coded(blocks, books, label_type), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Codes with the errors of all rows of their label (nulls together) added up.

    Sums are combined before they are shuffled; the rows themselves meet them by a join that
    Spark broadcasts only if the written sums are small, and else splits where a label is hot.
    """
    table = cut(codes)
    sums = cut(table.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return table.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(listed(books).encode()).hexdigest()
    return with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


_ASSIGN = """
  select vec_id, part, arg_min(entry, (dist, entry)) as entry, min(dist) as dist from (
    select p.vec_id, p.part, b.entry,
           sum((p.x - b.x) * (p.x - b.x)) as dist
    from cells p join {books} b on p.part = b.part and p.place = b.place
    group by p.vec_id, p.part, b.entry)
  group by vec_id, part"""

_MEAN = """
  select b.part, b.entry, b.place, coalesce(m.x, b.x) as x
  from {books} b left join (
    select a.part, a.entry, c.place,
           (sum(c.x) - (((sum(c.x) % count(*)) + count(*)) % count(*))) // count(*) as x
    from ({assign}) a join cells c on a.vec_id = c.vec_id and a.part = c.part
    group by a.part, a.entry, c.place) m
  on b.part = m.part and b.entry = m.entry and b.place = m.place"""

OP12_SQL = f"""
with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (
  select vec_id, (i - 1) // (n // {PARTS}) as part, (i - 1) % (n // {PARTS}) as place,
         cast(floor({SCALE} * cast(x as double)) as bigint) as x
  from (select vec_id, len(embedding) as n, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from kept)),
seeds as (
  select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}),
books0 as (select part, entry, place, x from seeds join cells using (vec_id)),
books1 as materialized ({_MEAN.format(books="books0", assign=_ASSIGN.format(books="books0"))}),
books2 as materialized ({_MEAN.format(books="books1", assign=_ASSIGN.format(books="books1"))}),
final as materialized ({_ASSIGN.format(books="books2")}),
rows_ as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code,
         cast(sum(dist) as bigint) as error
  from final group by vec_id)
select r.vec_id, r.code, r.error,
       cast(sum(r.error) over (partition by k.label) as bigint) as label_error,
       (select sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by part, entry, place)) from books2) as codebooks_sha256
from rows_ r join kept k on r.vec_id = k.vec_id
"""

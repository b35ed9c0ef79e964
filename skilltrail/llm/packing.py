"""Best-fit packing by a grouping genetic algorithm over islands.

Documents are tokenised whole, cut only where they exceed a sequence, and dealt by hash to
blocks of a few thousand pieces. Each block is evolved on several islands. A chromosome is a
set of bins: crossover injects whole well-filled bins of one parent into another, removes the
bins that hold a piece twice and best-fits the displaced pieces. Between epochs each island's
elite moves on to the next island. Badly filled bins of all blocks are opened again and packed
together on the next level, so that the waste does not grow with the number of blocks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltrail.llm.tokens import as_binary, encoder, public_path, text_slices, with_end
from skilltrail.session import cut, cut_counted

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
BLOCK_PIECES = 2048
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6
#: A bin with more free places than this share is opened again on the next level.
OPEN_SHARE = 1 / 256
LEVELS = 5


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit) of all documents.

    A document is its ids and the end id; null and empty texts are the end id alone. Only a
    longer document than `capacity` is cut, into full pieces and a rest. Equal rows each
    give their own pieces.
    """
    name = vocabulary

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(name or public_path(VOCABULARY), False)
        for whole in batches:
            for batch in text_slices(whole, 1):
                flat, bounds = with_end(*words.ids_of(batch.column(1)), end_id)
                counts = np.diff(bounds)
                cuts = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), cuts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, counts[owner] - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        as_binary(flat, np.concatenate([[0], np.cumsum(length)])).cast(pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tokenise, "doc_id long, piece int, start long, length long, ids binary"
    )


class Bins:
    """A chromosome: the bins of one packing, with best fit over their free places."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.members: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def add(self, members: list[int], free: int) -> None:
        self.by_free.setdefault(free, []).append(len(self.free))
        self.mask |= 1 << free
        self.members.append(members)
        self.free.append(free)

    def fit(self, items: list[int]) -> None:
        """Put each piece where it leaves least free, or into a new bin."""
        lengths, by_free = self.lengths, self.by_free
        for item in items:
            size = lengths[item]
            above = self.mask >> size
            if not above:
                self.add([item], self.capacity - size)
                continue
            free = size + (above & -above).bit_length() - 1
            held = by_free[free]
            at = held.pop()
            if not held:
                self.mask &= ~(1 << free)
            self.members[at].append(item)
            self.free[at] = left = free - size
            by_free.setdefault(left, []).append(at)
            self.mask |= 1 << left

    def cost(self) -> tuple[int, float]:
        """Bins, then the usual measure of uneven filling: fewer and fuller is better."""
        c = self.capacity
        return len(self.free), -sum(((c - f) / c) ** 2 for f in self.free)

    def assignment(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), dtype="<i4")
        for at, members in enumerate(self.members):
            out[members] = at
        return out


def bins_of(assignment: np.ndarray, lengths: list[int], capacity: int) -> Bins:
    """The chromosome of an assignment of pieces to bins."""
    groups: dict[int, list[int]] = {}
    for item, at in enumerate(assignment.tolist()):
        groups.setdefault(at, []).append(item)
    found = Bins(lengths, capacity)
    for members in groups.values():
        found.add(members, capacity - sum(lengths[i] for i in members))
    return found


def crossover(one: Bins, other: Bins, rng: random.Random) -> Bins:
    """Whole well-filled bins of `other` put into `one`; pieces they displace are fitted again."""
    slack = one.capacity // 100
    injected = [i for i, f in enumerate(other.free) if f <= slack and rng.random() < 0.3]
    taken = {item for i in injected for item in other.members[i]}
    child, displaced = Bins(one.lengths, one.capacity), []
    for i in injected:
        child.add(list(other.members[i]), other.free[i])
    worst = sorted(range(len(one.free)), key=one.free.__getitem__)[-max(2, len(one.free) // 50) :]
    opened = set(worst)
    for i, members in enumerate(one.members):
        if i in opened or not taken.isdisjoint(members):
            displaced += [item for item in members if item not in taken]
        else:
            child.add(list(members), one.free[i])
    displaced.sort(key=lambda item: (-one.lengths[item], item))
    child.fit(displaced)
    return child


def evolve(
    lengths: list[int], capacity: int, seeds: list[np.ndarray], seed: int, generations: int, population: int
) -> np.ndarray:
    """The best packing that a few generations give; ends at the lower bound."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    herd = [bins_of(s, lengths, capacity) for s in seeds]
    while len(herd) < population:
        noise = 0.0 if not herd else 0.1 * len(herd)
        order = sorted(
            range(len(lengths)), key=lambda i: -lengths[i] * (1 + noise * (rng.random() - 0.5))
        )
        fresh = Bins(lengths, capacity)
        fresh.fit(order)
        herd.append(fresh)
        if len(fresh.free) == least:
            break
    herd.sort(key=Bins.cost)
    for _ in range(generations):
        if len(herd[0].free) <= least or len(herd) < 2:
            break
        one, other = rng.sample(herd, 2)
        herd = sorted([*herd, crossover(one, other, rng)], key=Bins.cost)[:population]
    return herd[0].assignment()


def _evolved(state: DataFrame, capacity: int, epoch: int, generations: int, population: int) -> DataFrame:
    """One epoch on every island; `seeds` holds the packings it starts from."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                seeds = [np.frombuffer(s, dtype="<i4") for s in row["seeds"]]
                number = row["block"] * 1009 + row["island"] * 31 + epoch
                best = evolve(lengths, capacity, seeds, number, generations, population)
                bins, rough = bins_of(best, lengths, capacity).cost()
                yield pa.RecordBatch.from_pylist(
                    [row | {"seeds": [best.tobytes()], "bins": bins, "rough": rough}], schema=batch.schema
                )

    return state.mapInArrow(step, state.schema)


def _level(items: DataFrame, n: int, capacity: int, block_pieces: int, islands: int, epochs: int) -> DataFrame:
    """item, length, block, bin, offset and free places of one packing of all `n` items."""
    blocks = max(1, -(-n // block_pieces))
    state = (
        items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("item", "length"))).alias("held"))
        .select(
            "block",
            F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
            F.col("held.item").alias("items"),
            F.col("held.length").alias("lengths"),
            F.array().cast("array<binary>").alias("seeds"),
            F.lit(0).alias("bins"),
            F.lit(0.0).alias("rough"),
        )
    )
    ring = Window.partitionBy("block").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(epochs):
        state = _evolved(state.repartition("block", "island"), capacity, epoch, GENERATIONS, POPULATION)
        if epoch < epochs - 1:
            guest = F.coalesce(F.lead("seeds").over(ring), F.first("seeds").over(whole))
            state = state.withColumn("guest", guest).withColumn("seeds", F.concat("seeds", "guest")).drop("guest")
    best = state.groupBy("block").agg(
        F.min_by(F.struct("items", "lengths", "seeds"), F.struct("bins", "rough", "island")).alias("best")
    )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best = row["best"]
                at = np.frombuffer(best["seeds"][0], dtype="<i4")
                sizes = np.array(best["lengths"], dtype=np.int64)
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(sizes[order])
                opens = np.concatenate([[True], np.diff(at[order]) > 0])
                begin = np.repeat((ends - sizes[order])[opens], np.diff([*np.flatnonzero(opens), len(at)]))
                used = np.bincount(at, weights=sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(best["items"], dtype=np.int64)[order]),
                        pa.array(sizes[order]),
                        pa.array(np.full(len(at), row["block"], dtype=np.int64)),
                        pa.array(at[order].astype(np.int64)),
                        pa.array(ends - sizes[order] - begin),
                        pa.array(capacity - used[at[order]]),
                    ],
                    names=["item", "length", "block", "bin", "offset", "free"],
                )

    return best.mapInArrow(
        flatten, "item long, length long, block long, bin long, offset long, free long"
    )


def pack(
    table: DataFrame,
    capacity: int = CAPACITY,
    block_pieces: int = BLOCK_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
) -> DataFrame:
    """Rows with a `length` of 1 to `capacity`, put into sequences: adds sequence_id and offset.

    Every row is placed once, equal rows each for themselves; offsets in a sequence are
    gapless from 0. Columns named sequence_id and offset are replaced. No rows give none.
    A row of full length is a sequence of its own. Blocks are dealt by a row number, so no
    value of any column makes one of them large.
    """
    table = cut(table.drop("sequence_id", "offset").withColumn("_item", F.monotonically_increasing_id()))
    rest = table.where(F.col("length") < capacity).select(F.col("_item").alias("item"), "length")
    n = rest.count()
    placed, level = None, 0
    while n:
        packed = cut(_level(rest, n, capacity, block_pieces, islands, epochs))
        last = n <= block_pieces or level == LEVELS - 1
        done = packed if last else packed.where(F.col("free") <= int(capacity * OPEN_SHARE))
        # Level, block and bin in one number: 2**24 bins in a block, 2**34 blocks.
        number = F.lit(level << 58) + F.shiftleft("block", 24) + F.col("bin")
        done = done.select(F.col("item").alias("_item"), number.alias("sequence_id"), "offset")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        rest, n = cut_counted(
            packed.where(F.col("free") > int(capacity * OPEN_SHARE)).select("item", "length")
        )
        level += 1
    full = table.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.lit(LEVELS << 58) + F.col("_item"), "offset": F.lit(0).cast("long")}
    )
    if placed is not None:
        full = table.where(F.col("length") < capacity).join(placed, "_item").unionByName(full)
    return full.drop("_item")


def sequences(table: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (little-endian 32-bit).

    `table` has doc_id, piece and ids, `packed` doc_id, piece, sequence_id and offset; doc_id
    and piece must identify a piece. A sequence has at most `capacity` ids, so its group is
    bounded.
    """
    rows = table.select("doc_id", "piece", "ids").join(packed, ["doc_id", "piece"])
    return rows.groupBy("sequence_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(offset, ids))), x -> hex(x.ids)), '')").alias("h")
    ).select("sequence_id", F.unhex("h").alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of `docs`."""
    digest = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

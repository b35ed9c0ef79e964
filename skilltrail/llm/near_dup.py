"""Near copies by HyperMinHash: compressed registers, banding, corrected estimates, exact checks.

A text's word shingles fill a fixed number of buckets (those left empty are filled in further
rounds over the same shingles, so short texts have full sketches too). A bucket's register
keeps the leading zeros of its least hash and the mantissa bits after them. Texts that agree
in a band of registers are candidates; the share of equal registers, less what collisions
explain, estimates the Jaccard similarity; what may reach the threshold is checked on the
full sets.

Equal sets are one class from the start. Buckets of bands are never multiplied out: first
every class is checked against the leader it shares most bands with, which joins most copies;
only classes of one bucket that are then still in different components are compared further,
first by the likeliest pair of two components, then in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.tokens import give_back, text_slices
from skilltrail.llm.words import mixed, split_words, word_hashes
from skilltrail.session import cut, cut_counted

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard errors below the threshold down to which an estimate is still checked.
MARGIN = 4.0
#: Ids up to which a table of ids is broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of one group in which classes of different components are compared.
BLOCK = 256
#: Rounds over likeliest pairs of components, before what is still apart is compared in full.
BEST_ROUNDS = 2
#: Shingles, in all, of the classes that are sent to one spot for their full check.
BLOCK_SHINGLES = 1 << 18


def shingle_sets(words: pa.Array, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, end to end, with bounds.

    A text of fewer words than `size` has them all as its one shingle; no words, no shingle.
    """
    hashes = word_hashes(words)
    docs = len(bounds) - 1
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    sums = np.zeros(n, dtype=np.uint64)
    inside = np.arange(n) - bounds[:-1][owner]
    count = np.diff(bounds)[owner]
    for k in range(min(size, n)):
        # Short texts add up only their own words.
        ok = np.flatnonzero(inside[: n - k] + k < count[: n - k])
        sums[ok] += hashes[ok + k] * factors[k]
    starts = (inside + size <= count) | ((inside == 0) & (count < size))
    values = mixed(sums[starts] + np.minimum(count[starts], size).astype(np.uint64))
    owner = owner[starts]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(docs + 1))


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """REGISTERS registers of 16 bits for each set; zeros for an empty set."""
    docs = len(bounds) - 1
    sizes = np.diff(bounds)
    registers = np.zeros((docs, REGISTERS), dtype=np.uint16)
    empty = np.ones((docs, REGISTERS), dtype=bool)
    owner = np.repeat(np.arange(docs), sizes)
    turn = 0
    while len(values):
        seen = mixed(values + mixed(np.array([turn + 1], dtype=np.uint64))[0])
        bucket = (seen % np.uint64(REGISTERS)).astype(np.int64)
        if turn >= 4 * REGISTERS:  # a bucket that chance has left empty so long is filled in turn
            bucket[:] = turn % REGISTERS
        free = empty[owner, bucket]
        place = owner[free] * REGISTERS + bucket[free]
        rest = seen[free] // np.uint64(REGISTERS)
        order = np.lexsort((rest, place))
        place, rest = place[order], rest[order]
        first = np.ones(len(place), dtype=bool)
        first[1:] = place[1:] != place[:-1]
        place, rest = place[first], rest[first]
        # 56 bits: leading zeros, then the bits after the leading one.
        length = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))[1]
        zeros = np.clip(56 - length, 0, 15) + 16 * min(turn, 3)
        shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
        mantissa = (rest >> shift) & np.uint64((1 << MANTISSA) - 1)
        registers.reshape(-1)[place] = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
        empty.reshape(-1)[place] = False
        open_docs = empty.any(axis=1)
        keep = open_docs[owner]
        values, owner = values[keep], owner[keep]
        turn += 1
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch; bands never share keys but by chance."""
    factors = mixed(np.arange(1000, 1000 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
    terms = (registers.astype(np.uint64) + np.uint64(1)) * factors
    return mixed(terms.reshape(len(registers), BANDS, ROWS).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))


def estimates(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs: equal registers, less the collisions to expect.

    Two registers of different hashes are equal if their leading zeros are, which the two
    sketches' own distributions tell, and their mantissas, by chance.
    """
    equal = (one == other).mean(axis=1)
    chance = np.zeros(len(one))
    zeros, others = one >> MANTISSA, other >> MANTISSA
    for level in np.union1d(np.unique(zeros), np.unique(others)):
        chance += (zeros == level).mean(axis=1) * (others == level).mean(axis=1)
    chance /= 1 << MANTISSA
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two set fingerprints, band keys and registers of every text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1, 1 << 20):
                values, bounds = shingle_sets(*split_words(batch.column(1)), size)
                registers = sketches(values, bounds)
                prints = []
                for salt in (11, 12):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values * np.uint64(2) + np.uint64(salt)))])
                    prints.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.uint64).view(np.int64))
                n = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        *map(pa.array, prints),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1, dtype=np.int32) * BANDS),
                            pa.array(band_keys(registers).reshape(-1).view(np.int64)),
                        ),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch,
        "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, registers binary",
    )


def _with_registers(pairs: DataFrame, registers: DataFrame) -> DataFrame:
    one = registers.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"))
    other = registers.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"))
    return pairs.join(one, "a").join(other, "b")


def likely(pairs: DataFrame, registers: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b, spot) whose estimate may reach the threshold."""
    least = least_estimate(threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, other = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                    for i in (3, 4)
                )
                yield batch.select(["a", "b", "spot"]).filter(pa.array(estimates(one, other) >= least))

    rows = _with_registers(pairs.select("a", "b", "spot"), registers).select("a", "b", "spot", "ra", "rb")
    return rows.mapInArrow(keep, "a long, b long, spot long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are linked: 100 * common >= percent * union.

    `pairs` has rows of pairs, as two lists `a` and `b`, and their `spot`: pairs of one spot are
    checked together, and each text is sent there and taken apart once, however many pairs it is
    in. A pair that links found at its spot have already joined is not checked nor returned, so
    a spot returns fewer links than it has texts.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(len(whole)):
                asked = np.stack([whole.column(i)[row].values.to_numpy() for i in (0, 1)], axis=1)
                sent = whole.column(2)[row].values
                ids = sent.field("doc_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                values, bounds = shingle_sets(*split_words(sent.field("text").take(pa.array(order))), size)
                codes = np.unique(values, return_inverse=True)[1]
                one, other = np.unique(asked, axis=0).T
                joined = {number: number for number in np.unique(ids).tolist()}

                def root(number: int, joined: dict[int, int] = joined) -> int:
                    while joined[number] != number:
                        joined[number] = number = joined[joined[number]]
                    return number

                # An id may have several texts; any of them can make the link.
                keep = np.zeros(len(one), dtype=bool)
                marked = np.zeros(len(codes), dtype=bool)
                for k in range(len(ids)):
                    mine = codes[bounds[k] : bounds[k + 1]]
                    marked[mine] = True
                    for at in range(*np.searchsorted(one, [ids[k], ids[k] + 1])):
                        if root(int(one[at])) == root(int(other[at])):
                            continue
                        for o in range(*np.searchsorted(ids, [other[at], other[at] + 1])):
                            theirs = codes[bounds[o] : bounds[o + 1]]
                            common = int(marked[theirs].sum())
                            union = len(mine) + len(theirs) - common
                            keep[at] |= common > 0 and 100 * common >= percent * union
                        if keep[at]:
                            joined[root(int(one[at]))] = root(int(other[at]))
                    marked[mine] = False
                yield pa.RecordBatch.from_arrays([pa.array(one[keep]), pa.array(other[keep])], names=["a", "b"])
            give_back()

    lists = [F.flatten(F.collect_list(side)).alias(side) for side in ("a", "b")]
    asked = cut(pairs.groupBy("spot").agg(*lists))
    needed = asked.select("spot", F.explode(F.array_distinct(F.concat("a", "b"))).alias("doc_id"))
    sent = needed.join(texts, "doc_id").groupBy("spot").agg(F.collect_set(F.struct("doc_id", "text")).alias("sent"))
    return asked.join(sent, "spot").select("a", "b", "sent").mapInArrow(check, "a long, b long")


def _spots(first: DataFrame, sizes: DataFrame) -> DataFrame:
    """cid and spot of every class: classes with the same leader `b` lie together.

    `first` has cid and b, `sizes` cid and n_shingles. A leader with many classes has several
    spots, of about BLOCK classes and BLOCK_SHINGLES shingles.
    """
    rows = first.join(sizes, "cid")
    parts = rows.groupBy("b").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    return rows.join(parts, "b").select(
        "cid", F.xxhash64("b", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("spot")
    )


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of the edges (a, b).

    Each round takes the least component of the neighbours and then that component's own, so
    the rounds grow with the logarithm of the longest path. Least values are combined before
    each shuffle; a node of any degree is one row there.
    """
    both = cut(
        edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a != b").distinct()
    )
    state = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    ))
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = state.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("via")
        )
        jump = state.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = step.join(jump, "via").select("node", "was", F.least("via", "far").alias("component"))
        state = cut(moved)
        if state.where("was != component").isEmpty():
            return state.select("node", "component")
        state = state.select("node", "component")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (cid) with their component so far, which is their own id if they have none."""
    if labels is None:
        return members.withColumn("component", F.col("cid"))
    rows = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    return rows.withColumn("component", F.coalesce("component", "cid"))


def _cross_pairs(
    members: DataFrame, registers: DataFrame, spots: DataFrame, threshold: float, best_only: bool
) -> DataFrame:
    """Likely pairs between different components of one bucket: lists a and b, and their spot.

    `members` has key, cid and component, `registers` doc_id, n_shingles and registers, `spots`
    cid and spot; registers are joined to the members of mixed buckets alone. A bucket is cut into
    blocks of about BLOCK members by a hash, and blocks are compared pair by pair, so a group is
    bounded. Only likely pairs leave it; with `best_only` just the likeliest of two components.
    """
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed_keys = cut(sizes.where("low < high").select("key", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks")))
    rows = (
        members.join(mixed_keys, "key")
        .join(registers.withColumnRenamed("doc_id", "cid"), "cid")
        .join(spots, "cid")
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("block", "with").alias("i"),
            F.greatest("block", "with").alias("j"),
            F.struct("cid", "component", "n_shingles", "block", "spot", "registers").alias("member"),
        )
    )
    groups = rows.groupBy("key", "i", "j").agg(F.collect_list("member").alias("members"))
    least = least_estimate(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for group in range(len(whole)):
                members = whole.column(3)[group].values
                ids, labels, n, block, spots = (
                    members.field(name).to_numpy() for name in ("cid", "component", "n_shingles", "block", "spot")
                )
                registers = np.frombuffer(
                    b"".join(members.field("registers").to_pylist()), dtype=np.uint16
                ).reshape(-1, REGISTERS)
                zeros = registers >> MANTISSA
                shares = np.stack([(zeros == level).mean(axis=1) for level in np.unique(zeros)], axis=1)
                split = whole.column(1)[group].as_py() != whole.column(2)[group].as_py()
                one, other, near = [], [], []
                for k in range(len(ids)):
                    ok = (labels != labels[k]) & (ids > ids[k])
                    ok &= np.minimum(n, n[k]) >= threshold * np.maximum(n, n[k])
                    if split:
                        ok &= block != block[k]
                    others = np.flatnonzero(ok)
                    if len(others):
                        # As in `estimates`, with each member's shares of levels counted once.
                        equal = np.count_nonzero(registers[others] == registers[k], axis=1) / REGISTERS
                        chance = shares[others] @ shares[k] / (1 << MANTISSA)
                        estimate = (equal - chance) / (1 - chance)
                        others, estimate = others[estimate >= least], estimate[estimate >= least]
                        one.append(np.full(len(others), k))
                        other.append(others)
                        near.append(estimate)
                if not sum(map(len, one)):
                    continue
                one, other, near = (np.concatenate(parts) for parts in (one, other, near))
                low = np.minimum(labels[one], labels[other])
                high = np.maximum(labels[one], labels[other])
                if best_only:
                    order = np.lexsort((ids[other], ids[one], near, high, low))
                    last = np.ones(len(order), dtype=bool)
                    last[:-1] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
                    keep = order[last]
                    one, other, near, low, high = (x[keep] for x in (one, other, near, low, high))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (ids[one], ids[other], low, high, near, spots[one], spots[other])],
                        names=["a", "b", "ca", "cb", "estimate", "sa", "sb"],
                    )
                    continue
                # All pairs of two spots leave as one row.
                here = np.sort(np.stack([spots[one], spots[other]], axis=1), axis=1)
                order = np.lexsort((here[:, 1], here[:, 0]))
                here, one, other = here[order], one[order], other[order]
                starts = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]).any(axis=1)])
                ends = pa.array(np.r_[starts, len(one)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here[starts, side]) for side in (0, 1)]
                    + [pa.ListArray.from_arrays(ends, pa.array(ids[side])) for side in (one, other)],
                    names=["sa", "sb", "a", "b"],
                )
            give_back()

    rows = groups.select("key", "i", "j", "members")
    spot = F.xxhash64(F.least("sa", "sb"), F.greatest("sa", "sb")).alias("spot")
    if not best_only:
        return rows.mapInArrow(compare, "sa long, sb long, a array<long>, b array<long>").select("a", "b", spot)
    pairs = rows.mapInArrow(compare, "a long, b long, ca long, cb long, estimate double, sa long, sb long")
    top = F.max_by(F.struct("a", "b", "sa", "sb"), F.struct("estimate", "a", "b")).alias("top")
    best = pairs.groupBy("ca", "cb").agg(top).select("top.*")
    return best.select(F.array("a").alias("a"), F.array("b").alias("b"), spot)


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows are linked if their sets of `size`-word shingles (A-Z lower-cased) have
    100 * common >= percent * union; component_id is the smallest doc_id reachable over
    links, and the row that has it is kept. A text without words is linked with nothing.
    doc_id is taken to identify a text: equal rows stay or go together, and rows that share an
    id but not a text are linked through the id. A row without doc_id has no component and is
    kept. Other columns are ignored. An empty table gives no rows.

    A pair at the threshold itself shares no band with probability 3e-6.
    """
    threshold = percent / 100
    table = cut(sketched(docs, size))
    classes = cut(
        table.where("n_shingles > 0 and doc_id is not null")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("cid"))
    )
    ids = classes.select(F.col("cid").alias("doc_id"))
    reps = table.where("n_shingles > 0").join(ids, "doc_id", "left_semi")
    bands = reps.select(F.col("doc_id").alias("cid"), F.explode("bands").alias("key"))
    leaders, n = cut_counted(
        bands.groupBy("key").agg(F.min("cid").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    labels = None
    if n:
        members = cut(bands.join(leaders, "key").distinct())
        shared = members.where("cid != leader").groupBy("cid", "leader").count()
        first = cut(shared.groupBy("cid").agg(
            F.max_by("leader", F.struct("count", -F.col("leader"))).alias("b")
        ))
        involved, n = cut_counted(
            members.select("cid").distinct().withColumnRenamed("cid", "doc_id")
        )
        some = F.broadcast(involved) if n <= BROADCAST_IDS else involved
        texts = cut(
            docs.select(F.col("doc_id").cast("long"), "text")
            .where(F.col("text").isNotNull())
            .join(some, "doc_id", "left_semi")
        )
        registers = cut(
            table.select("doc_id", "n_shingles", "registers").join(some, "doc_id", "left_semi").distinct()
        )
        # A class that leads all its buckets lies with those it leads.
        led = members.select(F.col("cid")).distinct().join(first, "cid", "left")
        spots = cut(_spots(
            led.select("cid", F.coalesce("b", "cid").alias("b")),
            registers.groupBy(F.col("doc_id").alias("cid")).agg(F.max("n_shingles").alias("n_shingles")),
        ))
        led = first.join(spots, "cid").withColumnRenamed("cid", "a")
        near = likely(led, registers, threshold).select(F.array("a").alias("a"), F.array("b").alias("b"), "spot")
        edges = cut(verified(near, texts, size, percent))
        labels = None if edges.isEmpty() else components(edges)

        def cross(best_only: bool) -> DataFrame:
            """Linked pairs of classes that share a bucket but, so far, no component."""
            rows = _labelled(members.select("key", "cid"), labels)
            pairs = _cross_pairs(rows, registers, spots, threshold, best_only)
            return cut(verified(pairs, texts, size, percent))

        # The likeliest pair of two components joins most that belong together ...
        for _ in range(BEST_ROUNDS):
            more = cross(True)
            if more.isEmpty():
                break
            edges = edges.union(more)
            labels = components(edges)
        # ... and what is still apart is compared in full.
        last = cross(False)
        if not last.isEmpty():
            labels = components(edges.union(last))
    own = table.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left")
    own = own.withColumn("cid", F.when(F.col("n_shingles") > 0, F.col("cid")).otherwise(F.col("doc_id")))
    named = _labelled(own, labels)
    named = named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one document of each group stays."""
    gone, n = cut_counted(near_copies(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_gone")))
    gone = F.broadcast(gone) if n <= BROADCAST_IDS else gone
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents by 4-word shingles."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 80)

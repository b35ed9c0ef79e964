"""Order MinHash: fingerprints of whole texts that follow edit distance.

A text's k-mers are numbered by occurrence, so repeats count, and put in a random order by hash.
Each slot of a fingerprint takes the least few of them in an order of its own, lays them in the
order in which they stand in the text, and keeps a hash of that tuple. Two texts agree in a slot if
they share these k-mers and their order, which an edit far away leaves as it is, but a moved
passage does not.

The slots' orders are one hash ring entered at equally spaced points: slot j of m takes the first
k-mers at or above j/m of the ring. Each is a random order by itself, and one sort serves all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skilltrail.llm.tokens import text_slices
from skilltrail.llm.words import mixed
from skilltrail.session import cut

#: Characters of a k-mer, k-mers of a tuple, tuples of a fingerprint.
KMER, TUPLE, SLOTS = 5, 2, 64
#: Hexadecimal digits of a slot.
DIGITS = 4
#: Low bits of a sorted key that hold the place in the text; longer texts are sorted by two keys.
_PLACE_BITS = 24
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers in text order; a shorter text is one k-mer."""
    k = min(k, len(codes))
    whole, width, factor = None, 1, _FACTOR
    run = codes.astype(np.uint64) + np.uint64(1)
    # Polynomials of 1, 2, 4 ... characters; those of the binary digits of k are put together.
    done = 0
    while True:
        if k & width:
            if whole is None:
                whole = run
            else:
                whole = run[: len(run) - done] * _power(done) + whole[width:]
            done += width
        if done == k:
            return mixed(whole + np.uint64(k * int(_STEP) % (1 << 64)))
        run = run[:-width] * factor + run[width:]
        width *= 2
        factor = _power(width)


def text_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a text's k-mers in text order; an empty text has none.

    In a text below 4 k characters one edit would break most of them, so that shorter ones, from
    a quarter of the text on, stand beside them; those of one place stand by length.
    """
    n = len(codes)
    if n >= 4 * k or not n:
        return kmer_hashes(codes, k) if n else np.zeros(0, dtype=np.uint64)
    sizes = range(min(n, max(1, n // 4)), min(n, k) + 1)
    found = [kmer_hashes(codes, size) for size in sizes]
    order = np.argsort(np.concatenate([np.arange(len(x)) for x in found]), kind="stable")
    return np.concatenate(found)[order]


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def _sorted_places(keys: np.ndarray, most: int = 1 << _PLACE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the keys' high bits, then of place, and these high bits."""
    low = np.uint64(_PLACE_BITS)
    if len(keys) <= most:
        packed = np.sort((keys >> low << low) | np.arange(len(keys), dtype=np.uint64))
        return (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), packed >> low
    order = np.argsort(keys >> low, kind="stable")
    return order, keys[order] >> low


def slots_of(codes: np.ndarray, k: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS) -> np.ndarray:
    """The fingerprint's slots as numbers below 2**16; all 0 for an empty text."""
    kmers = text_kmers(codes, k)
    if not len(kmers):
        return np.zeros(slots, dtype=np.uint64)
    # How often the same k-mer stands before each place.
    place, high = _sorted_places(kmers)
    index = np.arange(len(kmers))
    fresh = np.ones(len(kmers), dtype=bool)
    np.not_equal(high[1:], high[:-1], out=fresh[1:])
    nth = index - np.maximum.accumulate(np.where(fresh, index, 0))
    keys = np.empty_like(kmers)
    keys[place] = mixed(kmers[place] + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
    # The first k-mers of the ring from each slot's point on, then in text order.
    place, high = _sorted_places(keys)
    points = (np.arange(slots, dtype=np.uint64) << np.uint64(64 - _PLACE_BITS)) // np.uint64(slots)
    enter = np.searchsorted(high, points, side="left")
    taken = (enter[:, None] + np.arange(min(tuple_size, len(kmers)))) % len(kmers)
    ordered = np.sort(place[taken], axis=1)
    found = np.full(slots, len(taken[0]), dtype=np.uint64)
    for column in ordered.T:
        found = mixed(found * _FACTOR + kmers[column])
    return found >> np.uint64(64 - 4 * DIGITS)


def as_text(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def fingerprint(text: str | None, k: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS) -> str:
    """A text's fingerprint, `DIGITS` hexadecimal digits a slot; null counts as empty."""
    return as_text(slots_of(code_points(text or ""), k, tuple_size, slots))


def share_equal(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def likeness(a: Column | str, b: Column | str, slots: int = SLOTS) -> Column:
    """Share of the slots in which two fingerprint columns agree; null if one is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    starts = F.sequence(F.lit(1), F.lit(DIGITS * (slots - 1) + 1), F.lit(DIGITS))
    same = F.filter(starts, lambda i: F.substr(a, i, F.lit(DIGITS)) == F.substr(b, i, F.lit(DIGITS)))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same) / F.lit(float(slots)))


def fingerprinted(
    docs: DataFrame, k: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS, text: str = "text"
) -> DataFrame:
    """All rows and columns with their text's `fingerprint`; a column of that name is replaced.

    Null and empty texts share the fingerprint of nothing; texts below `4 k` characters have
    shorter k-mers as well. Equal texts have equal fingerprints; equal rows all stay. An empty
    table stays empty.
    """
    kept = docs.drop("fingerprint")
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, at):
                found = [fingerprint(x, k, tuple_size, slots) for x in batch.column(at).to_pylist()]
                yield batch.append_column("fingerprint", pa.array(found, pa.string()))

    return kept.mapInArrow(add, schema)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following text."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


_NEIGHBOURS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part int, opens boolean, closes boolean, text string"
)


def _compared(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    """Digest and fingerprint of the edited text, and the two likenesses."""
    changed = edited(text, following)
    new = own if changed == text else slots_of(code_points(changed))
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return digest, as_text(new), share_equal(own, new), share_equal(own, theirs)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted part against the next one; the last is left open, with its text."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()),
            ("opens", pa.bool_()), ("closes", pa.bool_()), ("text", pa.string()),
        ]
    )
    part, held = TaskContext.get().partitionId(), None
    opens = True

    def row(found: tuple, closes: bool) -> tuple:
        doc_id, text, own = held
        shown = text if opens or closes else None
        return (doc_id, len(text), found[0], as_text(own), *found[1:], part, opens, closes, shown)

    for whole in batches:
        for batch in text_slices(whole, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = slots_of(code_points(text))
                if held is not None:
                    rows.append(row(_compared(*held[1:], text, own), False))
                    opens = False
                held = doc_id, text, own
            yield _record(rows, schema)
    if held is not None:
        yield _record([row((None, None, None, None), True)], schema)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document.

    The next one follows in ascending doc_id (null first, equal ids by their texts' hash and text);
    the last one is followed by the first, so a single document by itself. The edited text has
    the last quarter of its characters replaced by the first ones of the next document. Null
    texts count as empty; equal rows each report theirs; an empty table gives no rows. Other
    columns are ignored.

    Documents are dealt by ranges of doc_id, the one exchange of texts, and a task compares its
    sorted rows as they pass. Only the last row of each part is left for a second step, with
    the first row of the next part that has any.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = (
        texts.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    table = cut(placed.mapInArrow(_along, _NEIGHBOURS))
    firsts = table.where("opens")
    # One row per part of the exchange: its number and that of the part behind it.
    parts = firsts.select("part")
    behind = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(Window.orderBy("part")),
            F.min("part").over(Window.partitionBy()),
        ).alias("next_part"),
    )
    openings = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    columns = [c for c in table.columns if c not in ("part", "opens", "closes", "text")]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = slots_of(code_points(text))
                found = _compared(text, own, following, slots_of(code_points(following)))
                rows.append((doc_id, len(text), found[0], as_text(own), *found[1:]))
            yield _record(
                rows,
                pa.schema(
                    [
                        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64()),
                    ]
                ),
            )

    closed = (
        table.where("closes")
        .select("doc_id", "text", "part")
        .join(behind, "part")
        .join(openings, "next_part")
        .select("doc_id", "text", "next_text")
        .mapInArrow(close, _NEIGHBOURS.partition(", part ")[0])
    )
    return table.where("not closes").select(*columns).unionByName(closed)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))

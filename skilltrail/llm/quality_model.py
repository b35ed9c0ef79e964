"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Learned filters slide over the
embedded bytes of a chunk and are max-pooled; the chunks' features are combined by mean and
maximum into one probability for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.tokens import text_slices
from skilltrail.llm.training import Adam, fold
from skilltrail.llm.words import plain_texts

CHUNK, HOP = 256, 192
DIM, WIDTH, STRIDE, FILTERS = 8, 6, 2, 32
#: Labelled texts that the network is fitted on, and chunks of each that training looks at.
SAMPLE, SAMPLE_CHUNKS = 4000, 6
EPOCHS, BATCH, RATE = 14, 32, 0.004
THRESHOLD = 0.3
_AT_ONCE = 128


def chunked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping chunks of each text's bytes (zero-padded rows) and the bounds of its rows.

    Every text has one chunk at least.
    """
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-(sizes - (CHUNK - HOP)) // HOP))
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(owner)) - np.repeat(ends - counts, counts)) * HOP
    place = start[:, None] + np.arange(CHUNK)
    inside = place < sizes[owner][:, None]
    rows = np.zeros((len(owner), CHUNK), dtype=np.uint8)
    if len(data):
        rows[inside] = data[(place + bounds[:-1][owner][:, None])[inside]]
    return rows, np.concatenate([[0], ends])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of texts, end to end, with bounds; null is empty."""
    texts = plain_texts(texts)
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class ByteNetwork:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bytes = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.out, self.base]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        seen = self.bytes[rows].reshape(len(rows), -1)
        view = np.lib.stride_tricks.sliding_window_view(seen, WIDTH * DIM, axis=1)
        return np.ascontiguousarray(view[:, :: STRIDE * DIM])

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The chunks' features: each filter's largest response, if positive."""
        out = np.empty((len(rows), FILTERS), dtype=np.float32)
        for at in range(0, len(rows), _AT_ONCE):
            some = self.windows(rows[at : at + _AT_ONCE])
            out[at : at + _AT_ONCE] = (some @ self.filters).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def combined(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(features, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(features, bounds[:-1], axis=0)], axis=1)

    def scores(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        if len(bounds) < 2:
            return np.zeros(0)
        logits = self.combined(self.pooled(rows), bounds) @ self.out + self.base
        return 1 / (1 + np.exp(-logits.astype(np.float64)))

    def gradients(self, rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over texts whose chunks are `rows`."""
        some = self.windows(rows)
        response = some @ self.filters
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :] + self.bias
        features = np.maximum(top, 0)
        whole = self.combined(features, bounds)
        error = 1 / (1 + np.exp(-(whole @ self.out + self.base))) - labels
        error = (error / len(labels)).astype(np.float32)
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(counts)), counts)
        up = error[:, None] * self.out
        is_max = features == whole[owner, FILTERS:]
        ties = np.add.reduceat(is_max.astype(np.float32), bounds[:-1], axis=0)
        down = (up[:, :FILTERS] / counts[:, None])[owner] + is_max * (up[:, FILTERS:] / ties)[owner]
        down *= top > 0
        # Only the windows that won a filter's pool pass their share on.
        won = some[np.arange(len(rows))[:, None], best]
        to_filters = np.einsum("cf,cfk->kf", down, won)
        to_seen = down[:, :, None] * self.filters.T[None]
        places = best[:, :, None] * STRIDE + np.arange(WIDTH)
        held = rows[np.arange(len(rows))[:, None, None], places].reshape(-1)
        to_seen = to_seen.reshape(-1, DIM)
        to_bytes = np.stack([np.bincount(held, weights=to_seen[:, d], minlength=256) for d in range(DIM)], axis=1)
        return [to_bytes.astype(np.float32), to_filters, down.sum(axis=0), whole.T @ error, error.sum(keepdims=True)]

    def fit(self, rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """Stochastic gradient descent over texts in random order."""
        rng, steps = np.random.default_rng(seed), Adam(self.weights(), RATE)
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        self.base[:] = np.log(share / (1 - share))
        for epoch in range(EPOCHS):
            steps.rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                texts = order[at : at + BATCH]
                counts = np.diff(bounds)[texts]
                picked = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)])
                steps.step(self.gradients(rows[picked], ends, labels[texts]))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    """A network fitted on the `sample` labelled texts whose id hashes are smallest.

    `labels` has doc_id and quality (1 good, 0 bad); rows without either are left out. Of a
    sampled text up to SAMPLE_CHUNKS chunks, evenly spread over it, are used. Both bounds are
    parameters of the fit alone: scoring covers whole texts. Without labelled texts the
    network gives every text the same score of about a half.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                rows, bounds = chunked(*text_bytes(batch.column(1)))
                picked = [
                    rows[np.unique(np.linspace(a, b - 1, min(SAMPLE_CHUNKS, b - a)).astype(int))].tobytes()
                    for a, b in zip(bounds, bounds[1:], strict=False)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(picked, pa.binary())],
                    names=["doc_id", "quality", "chunks"],
                )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int"))
        .mapInArrow(cut_out, "doc_id long, quality int, chunks binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["chunks"])))
    network = ByteNetwork()
    if rows:
        held = [np.frombuffer(r["chunks"], dtype=np.uint8).reshape(-1, CHUNK) for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        network.fit(np.concatenate(held), bounds, np.array([r["quality"] for r in rows], dtype=np.float32))
    return network


def scored(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from THRESHOLD on) to every row.

    Columns of these names are replaced. All bytes of a text are covered; null and empty texts
    are one chunk of padding. Equal texts have equal scores; an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")
    weights = network.weights()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNetwork()
        model.bytes, model.filters, model.bias, model.out, model.base = weights
        for whole in batches:
            for batch in text_slices(whole, at, 1 << 20):
                found = model.scores(*chunked(*text_bytes(batch.column(at))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                    names=[*batch.schema.names, "score", "predicted"],
                )

    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.mapInArrow(score, schema)


def accepted(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """The rows of `docs`, with all their columns, that score THRESHOLD or more."""
    at = docs.columns.index("text")
    weights = network.weights()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNetwork()
        model.bytes, model.filters, model.bias, model.out, model.base = weights
        for whole in batches:
            for batch in text_slices(whole, at, 1 << 20):
                found = model.scores(*chunked(*text_bytes(batch.column(at))))
                yield batch.filter(pa.array(found >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from four of five labelled folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    network = fitted(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    # Only what the score needs goes through Python.
    return scored(docs, network).select("doc_id", held_out.alias("held_out"), "score", "predicted")

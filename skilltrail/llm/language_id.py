"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear layer turns it
into language probabilities. Both are trained by stochastic gradient descent in numpy on a
bounded sample, then calibrated: a temperature for the probabilities and a score below which
a prediction counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltrail.llm.quality_model import text_bytes
from skilltrail.llm.tokens import text_slices
from skilltrail.llm.training import Adam, fold
from skilltrail.llm.words import plain_texts

GRAMS = (2, 3, 5)
BUCKETS, DIM = 1 << 15, 16
#: Sampled texts of a language, and windows of each (characters at most).
SAMPLE, WINDOWS, WINDOW_CHARS = 600, 3, 300
EPOCHS, BATCH, RATE = 4, 64, 0.02
#: Share of right predictions that calibrated rejection may refuse.
REFUSED = 0.01
UNKNOWN = "und"
_HASH = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def gram_ids(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams inside each text, text by text, and their bounds.

    A text of L bytes has L n-grams of each length: those at its end are padded by spaces, as
    is its beginning by one.
    """
    docs, sizes = len(bounds) - 1, np.diff(bounds)
    # One space before each text, the longest n-gram's length behind it.
    pad = max(GRAMS)
    spread = np.full(len(data) + docs * (pad + 1), 32, dtype=np.uint32)
    owner = np.repeat(np.arange(docs), sizes)
    place = np.arange(len(data)) + owner * (pad + 1) + 1
    spread[place] = data
    starts = place - 1
    parts = []
    for turn, n in enumerate(GRAMS):
        seen = np.full(len(starts), turn + 1, dtype=np.uint32)
        for k in range(n):
            seen = (seen ^ spread[starts + k]) * _HASH[k % 3]
            seen ^= seen >> np.uint32(15)
        parts.append((seen & np.uint32(BUCKETS - 1)).astype(np.int32))
    return np.stack(parts, axis=1).reshape(-1), bounds * len(GRAMS)


class LanguageModel:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.linear = rng.normal(0, DIM**-0.5, (DIM, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)
        self.temperature, self.reject_below = 1.0, 0.0

    def means(self, table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Average of the table's rows over each text's n-grams; zeros for none."""
        out = np.zeros((len(bounds) - 1, table.shape[1]), dtype=np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            sums = np.stack(
                [np.add.reduceat(column[ids], bounds[full], dtype=np.float64) for column in np.ascontiguousarray(table.T)],
                axis=1,
            )
            out[full] = sums / np.diff(bounds)[full][:, None]
        return out

    def probabilities(self, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Calibrated probabilities; `table` may hold embedding times linear, worked out once."""
        table = self.embedding @ self.linear if table is None else table
        logits = (self.means(table, ids, bounds) + self.bias).astype(np.float64) / self.temperature
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)

    def fit(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        steps = Adam([self.embedding, self.linear, self.bias], RATE)
        for epoch in range(EPOCHS):
            steps.rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                texts = order[at : at + BATCH]
                counts = np.diff(bounds)[texts]
                picked = np.concatenate([ids[bounds[t] : bounds[t + 1]] for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)])
                hidden = self.means(self.embedding, picked, ends)
                logits = hidden @ self.linear + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(texts)), labels[texts]] -= 1
                p /= len(texts)
                share = np.repeat((p @ self.linear.T) / np.maximum(counts, 1)[:, None], counts, axis=0)
                to_embedding = np.stack(
                    [np.bincount(picked, weights=share[:, d], minlength=BUCKETS) for d in range(DIM)], axis=1
                )
                steps.step([to_embedding.astype(np.float32), hidden.T @ p, p.sum(axis=0)])

    def calibrate(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> None:
        """Temperature of least log loss, and the score that REFUSED of the right ones fall below."""
        if not len(labels):
            return
        losses = []
        grid = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
        for self.temperature in grid:
            p = self.probabilities(ids, bounds)
            losses.append(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())
        self.temperature = grid[int(np.argmin(losses))]
        p = self.probabilities(ids, bounds)
        right = p.max(axis=1)[p.argmax(axis=1) == labels]
        self.reject_below = float(np.quantile(right, REFUSED)) if len(right) else 0.0


def fitted(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model of the `lang` values of `docs` (text, lang), fitted on `sample` texts of each.

    Of a sampled text WINDOWS windows of up to WINDOW_CHARS characters are used, at places and
    of lengths that its hash chooses. These bounds are parameters of the fit alone: predictions
    read whole texts. The sample is that of the smallest hashes of distinct texts; a fifth of it
    serves to calibrate. Rows without text or lang are left out. The broadcast counts have a
    row for each language, as the model has a column.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h")
    )
    windows = []
    for turn in range(WINDOWS):
        h = F.xxhash64("h", F.lit(turn))
        size = F.lit(20) + F.pmod(F.shiftright(h, 32), F.lit(WINDOW_CHARS - 19))
        start = F.pmod(h, F.greatest(F.char_length("text") - size + 1, F.lit(1)).cast("long")) + 1
        windows.append(F.substring("text", start.cast("int"), size.cast("int")))
    # Only the lowest hashes can be among the sample; a copied text counts once, here too.
    counts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("h") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    first = Window.partitionBy("lang").orderBy("h")
    rows = (
        known.join(F.broadcast(counts), "lang")
        .where(share * F.col("n") < 16 * sample)
        .select("lang", "h", F.array(*windows).alias("windows"))
        .groupBy("lang", "h")
        .agg(F.min("windows").alias("windows"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= sample)
        .select("lang", "h", "windows")
        .collect()
    )
    rows.sort(key=lambda r: (r["h"], r["lang"], r["windows"]))
    languages = sorted({r["lang"] for r in rows})
    model = LanguageModel(languages)
    parts: tuple[list, list] = ([], [])
    for i, row in enumerate(rows):
        parts[i % 5 == 4].extend((w, languages.index(row["lang"])) for w in row["windows"] if w)
    for step, some in zip((model.fit, model.calibrate), parts, strict=True):
        if some:
            texts = pc.ascii_lower(pa.array([w for w, _ in some], pa.large_string()))
            step(*gram_ids(*text_bytes(texts)), np.array([label for _, label in some]))
    return model


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score and rejected to every row; columns of these names are replaced.

    The whole text is read. A text that is null or has no letter is `und` with score 0, as is
    every text if no language was learned. Any other text gets a learned language; `rejected`
    says that its score is below the calibrated bound. Equal texts have equal results; an empty
    table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")
    table = model.embedding @ model.linear
    small = LanguageModel.__new__(LanguageModel)
    small.languages, small.bias = model.languages, model.bias
    small.temperature, small.reject_below = model.temperature, model.reject_below

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*small.languages, UNKNOWN])
        for whole in batches:
            for batch in text_slices(whole, at, 1 << 20):
                texts = plain_texts(batch.column(at))
                lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                best = np.full(len(batch), len(small.languages))
                score = np.zeros(len(batch))
                if small.languages:
                    p = small.probabilities(*gram_ids(*text_bytes(pc.ascii_lower(texts))), table)
                    best = np.where(lettered, p.argmax(axis=1), len(small.languages))
                    score = np.where(lettered, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, names.take(pa.array(best)), pa.array(score), pa.array(score < small.reject_below)],
                    names=[*batch.schema.names, "lang_pred", "score", "rejected"],
                )

    schema = docs.select(
        "*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")
    ).schema
    return docs.mapInArrow(predict, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.where(F.col("doc_id").isNull() | (fold(F.col("doc_id"), 4) != 2))
    model = fitted(learned.select("text", "lang"))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )

import random
import zlib

import numpy as np
import pyarrow as pa

from skilltrail.llm.quality_model import (
    CHUNK,
    HOP,
    ByteNetwork,
    chunked,
    fitted,
    op5_quality_model,
    scored,
    text_bytes,
)


def test_chunks_cover_every_byte():
    texts = [None, "", "a", "é" * 100, "x" * CHUNK, "y" * (CHUNK + 1), "z" * 5000]
    rows, bounds = chunked(*text_bytes(pa.array(texts)))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        data = (text or "").encode()
        assert b - a == max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
        for i in range(a, b):
            start = (i - a) * HOP
            assert rows[i].tobytes() == data[start : start + CHUNK].ljust(CHUNK, b"\0")
        assert (b - a - 1) * HOP + CHUNK >= len(data)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    rows, bounds = chunked(*text_bytes(pa.array(["abc def " * 50, "xyz!! " * 9, ""])))
    labels = np.array([1, 0, 1], dtype=np.float32)
    network = ByteNetwork()

    def loss():
        p = network.scores(rows, bounds)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for weight, gradient in zip(network.weights(), network.gradients(rows, bounds, labels), strict=True):
        flat, slope = weight.reshape(-1), gradient.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3].tolist() + [int(rng.integers(len(flat)))]:
            old = flat[i]
            flat[i] = old + 1e-2
            high = loss()
            flat[i] = old - 1e-2
            low = loss()
            flat[i] = old
            assert abs((high - low) / 2e-2 - slope[i]) < 0.02 * abs(slope).max() + 1e-4


def brute(network, text):
    """One score by plain loops over chunks, windows and filters."""
    data = (text or "").encode()
    features = []
    for start in range(0, max(1, len(data) - (CHUNK - HOP)), HOP):
        chunk = data[start : start + CHUNK].ljust(CHUNK, b"\0")
        seen = [network.bytes[c] for c in chunk]
        windows = [np.concatenate(seen[i : i + 6]) for i in range(0, CHUNK - 5, 2)]
        features.append([max(0, max(w @ f for w in windows) + b) for f, b in zip(network.filters.T, network.bias, strict=True)])
    features = np.array(features)
    whole = np.concatenate([features.mean(axis=0), features.max(axis=0)])
    return 1 / (1 + np.exp(-(whole @ network.out + network.base[0])))


def test_scores_equal_plain_loops_on_odd_rows(spark):
    network = ByteNetwork(3)
    texts = [None, "", "a b", "long é " * 300, "long é " * 300]
    rows = [(i // 2, t, "s") for i, t in enumerate(texts)]
    found = scored(spark.createDataFrame(rows, "doc_id long, text string, score string"), network).collect()
    assert len(found) == 5
    for r in found:
        assert abs(r.score - brute(network, r.text)) < 1e-4
        assert r.predicted == int(r.score >= 0.3)
    assert scored(spark.createDataFrame([], "doc_id long, text string"), network).collect() == []


def test_learns_and_handles_missing_labels(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("etaoin", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 90))]
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((i if i % 50 else None, int(good) if i % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    network = fitted(docs, table)
    found = scored(docs, network).collect()
    right = [r.predicted == int("!" not in r.text) for r in found]
    assert np.mean(right) > 0.95
    none = fitted(docs, table.limit(0))
    assert {r.predicted for r in scored(docs, none).collect()} <= {0, 1}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op5_quality_model(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = [found[r.doc_id].predicted == r.quality for r in labels if found[r.doc_id].held_out]
    assert np.mean(right) > 0.85

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skilltrail.llm import near_dup
from skilltrail.llm.near_dup import (
    components,
    deduplicated,
    estimates,
    near_copies,
    shingle_sets,
    sketches,
)
from skilltrail.llm.words import split_words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    """(n_shingles, component) of each row, over all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        least[root(i)] = min(number, least.get(root(i), number))
    return sorted((n, len(sets[i]), least[root(i)]) for i, (n, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, bases = [(7, ""), (8, None), (9, "\n \t")], []
    for number in range(10, 10 + n):
        kind = rng.random()
        if kind < 0.5 or not bases:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 12, 40, 120]))
            if rng.random() < 0.2:
                words += passage
            bases.append(words)
        else:
            words = list(rng.choice(bases[-20:]))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6]) if len(words) > 6 else 0):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at]] * 2])
            words = words or ["x"]
        text = " ".join(words)
        rows.append((number, text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "seed"), [(4, 1), (5, 2)])
def test_components_equal_all_pairs(spark, size, seed):
    rows = corpus(seed, 500)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(3)
    got = near_copies(docs, size).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = deduplicated(docs, size)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_chain_and_big_blocks(spark, monkeypatch):
    # Each text differs a little from the one before: one component by links of neighbours alone.
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for number in range(60):
        for _ in range(2):
            words[rng.randrange(200)] = f"n{number}x{rng.random()}"
        rows.append((number * 13 % 61, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(docs, 4).collect())
    assert got == brute(rows, 4)


def test_checks_send_a_text_once_per_spot(spark):
    # A ring of texts around one base: many likely pairs, few links; one id has two texts, rows repeat.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for number in range(70):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 5, 8])):
            words[at] = f"n{number}x{at}"
        rows.append((number, " ".join(words)))
    rows += [(3, rows[4][1]), rows[5], rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(a, b) for a in range(70) for b in range(a + 1, 70)]
    lists = [([a, 69], [b, 69], a % 3) for a, b in pairs for _ in range(1 + a % 2)]
    asked = spark.createDataFrame(lists, "a array<long>, b array<long>, spot long")
    got = [(r.a, r.b) for r in near_dup.verified(asked, docs, 4, 80).collect()]
    sets = {}
    for number, text in rows:
        sets.setdefault(number, []).append(shingles(text, 4))
    want = {
        (a, b) for a, b in pairs
        if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    }
    assert set(got) <= want and len(got) < 3 * 70 < len(want) < len(pairs)

    def labels(links):
        label = list(range(70))
        for _ in range(70):
            for x, y in links:
                label[x] = label[y] = min(label[x], label[y])
        return label

    # The links that leave a spot join what all its links join.
    for spot in range(3):
        assert labels([p for p in got if p[0] % 3 == spot]) == labels([p for p in want if p[0] % 3 == spot])


def test_estimates_are_close():
    rng = random.Random(9)
    texts, truth = [], []
    for n in (3, 30, 300, 3000):
        for share in (0.0, 0.5, 0.8, 0.95):
            for _ in range(6):
                a = [str(rng.random()) for _ in range(n)]
                b = [w if rng.random() < share else str(rng.random()) for w in a]
                texts += [" ".join(a), " ".join(b)]
                x, y = shingles(texts[-2], 1), shingles(texts[-1], 1)
                truth.append(len(x & y) / len(x | y))
    values, bounds = shingle_sets(*split_words(pa.array(texts)), 1)
    registers = sketches(values, bounds)
    found = estimates(registers[::2], registers[1::2])
    errors = np.abs(found - truth)
    assert errors.max() < 0.16 and errors.mean() < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(1, 3), (50, 60), (60, 50), (55, 60), (70, 70)]
    edges += [(100 + i, 100 + i + 1) for i in range(30)]
    rng = random.Random(2)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[2] == 0 and got[3] == 0 and got[5] == 4 and got[60] == 50 and got[55] == 50
    assert all(got[100 + i] == 100 for i in range(31))


def test_odd_rows(spark):
    schema = "doc_id long, text string, component_id long"
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (None, "a b c d e f", 1), (4, "A b c d e f", 1), (6, "x " * 90000, 1)]
    got = near_copies(spark.createDataFrame(rows, schema), 4).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id) == [
        (4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (6, 1, 6, True)
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_copies(spark.createDataFrame([], schema), 4).collect() == []
    assert deduplicated(spark.createDataFrame(rows, schema), 4).count() == 3

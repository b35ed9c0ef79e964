import math
import random
from collections import defaultdict

import numpy as np
import pytest

from skilltrail.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"
NAN, INF = float("nan"), float("inf")


def plain(rows, entries, rounds):
    """The contract by plain loops: codes, errors and final codebooks."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // 16
    books = [[r[1][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(16)]

    def nearest(part, p):
        found = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                part = v[p * width : (p + 1) * width]
                members[p, nearest(part, p)[0]].append(part)
        for (p, e), parts in members.items():
            books[p][e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out = []
    for i, v, label in kept:
        picks = [nearest(v[p * width : (p + 1) * width], p) for p in range(16)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in picks), sum(d for _, d in picks)))
    return out, [c for book in books for e in book for c in e]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def vectors(rng, n, dims, spread=1.0):
    return [np.float32(rng.gauss(0, spread)).item() for _ in range(dims)] if n else []


@pytest.mark.parametrize(("dims", "entries", "spread"), [(16, 64, 0.1), (48, 5, 1.0), (32, 64, 1e4), (16, 256, 1e7)])
def test_equals_plain_loops(spark, dims, entries, spread):
    rng = random.Random(dims)
    rows = [(i, vectors(rng, 1, dims, spread), rng.choice([1, 1, 1, 2, None])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 9) for i in range(40)]  # copies: entries that stay unused
    want, books = plain(rows, entries, 2)
    broken = [(-1, None, 1), (-2, [], 1), (-3, [0.5] * (dims - 1) + [None], 1), (-4, [NAN] * dims, 1)]
    broken += [(-5, [INF] + [0.0] * (dims - 1), 1), (-6, [0.0] * (dims - 1) + [-INF], 2), (5000, [0.5], 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + broken], SCHEMA).repartition(6)
    codes, found = vc.compressed(frame, entries)
    assert vc.listed(found) == ",".join(map(str, books))
    assert order(tuple(r) for r in codes.collect()) == order(want)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    with_sums = vc.with_label_errors(codes).collect()
    assert len(with_sums) == len(want) and all(r.label_error == sums[r.label] for r in with_sums)


def test_few_rows_null_ids_and_equal_rows(spark):
    rows = [(None, [1.0] * 16, None), (3, [2.0] * 16, None), (3, [0.0] * 16, 1), (3, [0.0] * 16, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    codes, books = vc.compressed(frame)
    assert books.shape == (4, 16) and books[:, 0].tolist() == [0, 0, 512, 256]
    got = order(tuple(r) for r in codes.collect())
    assert got == order([(None, None, "03" * 16, 0), (3, None, "02" * 16, 0)] + [(3, 1, "00" * 16, 0)] * 2)


def test_empty_and_uncuttable(spark):
    for rows in ([], [(1, None, 2, "x", 1)]):
        codes, books = vc.compressed(spark.createDataFrame(rows, SCHEMA))
        assert codes.collect() == [] and books.size == 0 and vc.listed(np.zeros((0, 16), int)) == ""
    with pytest.raises(ValueError):
        vc.compressed(spark.createDataFrame([(1, [1.0] * 17, 1, "x", 1)], SCHEMA))


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    for low, high in ((-5, 5), (-300, 300), (-(1 << 27), 1 << 27)):
        grid = rng.integers(low, high + 1, (700, 8))
        grid[:, 3] = 7
        values, sizes, codes = vc.dictionaries(grid)
        assert (vc.decoded(sizes, values, codes).T == grid).all()
        assert sizes.sum() == len(values) == sum(len(set(c)) for c in grid.T.tolist())

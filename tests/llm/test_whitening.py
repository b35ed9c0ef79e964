import math
import random

import numpy as np
import pytest

from skilltrail.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, deviation string, white int"
NAN, INF = float("nan"), float("inf")


def cases():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectra = {
        "falling": 10.0 ** -np.arange(40),
        "ties": np.repeat([2.0, 1.0, 0.0, -1.0], 10),
        "near ties": np.repeat([2.0, 1.0], 20) + 1e-11 * np.arange(40),
        "one large": np.r_[1e9, rng.random(39)],
    }
    for name, values in spectra.items():
        yield name, q @ np.diag(values) @ q.T
    for n in (0, 1, 2, 3, 17, 90):
        b = rng.standard_normal((n, n + 2))
        yield f"random {n}", b @ b.T
    yield "identity", 3 * np.eye(6)
    yield "zero", np.zeros((4, 4))
    yield "diagonal", np.diag([1.0, 2, 3, 3, 1e-20, 0])
    yield "rank one", np.ones((12, 12))


@pytest.mark.parametrize(("name", "a"), list(cases()))
def test_eigenpairs(name, a):
    a = (a + a.T) / 2
    values, vectors = wh.eigenpairs(a)
    scale = np.linalg.norm(a) + 1e-300
    assert vectors.shape == a.shape
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max(initial=0) <= 1e-13 * scale
    assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max(initial=0) <= 1e-13


def test_polar_factor():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    for values in (rng.standard_normal(30), np.r_[1e-9, -1e-9, rng.standard_normal(28)]):
        want = q @ np.diag(np.sign(values)) @ q.T
        assert np.abs(wh.polar_factor(q @ np.diag(values) @ q.T) - want).max() < 1e-6
    assert wh.polar_factor(np.zeros((3, 3))) is None


def integers(v):
    return [math.floor(64 * x) + 1000000 for x in v]


@pytest.mark.parametrize(("dims", "rows", "parts"), [(6, 400, 5), (40, 900, 3), (8, 5, 2)])
def test_rows_equal_numpy(spark, dims, rows, parts):
    rng = random.Random(dims)
    given = [(i, [np.float32(rng.gauss(0, 1 + j)).item() for j in range(dims)]) for i in range(rows)]
    given += [(i % 7, given[3][1]) for i in range(rows // 3)]  # copies
    broken = [(-1, None), (-2, []), (-3, [None] * dims), (-4, [NAN] * dims), (-5, [INF] * dims), (9999, [1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in given + broken], SCHEMA).repartition(parts)
    kept, length, model = wh.fitted(frame)
    assert length == dims and model.n == len(given)
    x = np.array([integers(v) for _, v in given])
    assert model.total.tolist() == x.sum(axis=0).tolist()
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / len(x)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(32, int((values > 1e-10 * values.sum()).sum()))
    assert len(model.values) == count
    assert model.explained == pytest.approx((values[:count] / values.sum()).tolist(), rel=1e-9)
    white = centred @ (vectors[:, :count] / np.sqrt(values[:count]))
    found = wh.whitened(kept, dims, model).collect()
    assert len(found) == len(given)
    sign = np.sign(np.einsum("ij,ij->j", model.vectors, vectors[:, :count]))
    want = {}
    for (i, _), row, ints in zip(given, white * sign, x.tolist(), strict=True):
        off = [len(x) * a - s for a, s in zip(ints, model.total.tolist(), strict=True)]
        want.setdefault((i, sum(o * o for o in off)), row)
    for r in found:
        assert r.white == pytest.approx(want[r.vec_id, r.deviation].tolist(), abs=1e-7)
    assert wh.identity_error(kept, dims, model) < 1e-9


def test_lost_dimensions_and_large_components(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, 1e4 * (i % 3)], "x", 1) for i in range(50)]
    kept, dims, model = wh.fitted(spark.createDataFrame(rows, SCHEMA))
    assert len(model.values) == 2
    found = wh.whitened(kept, dims, model).collect()
    assert len(found) == 50 and all(np.isfinite(r.white).all() and r.deviation > 0 for r in found)
    assert wh.identity_error(kept, dims, model) < 1e-6


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [1e30 * (-1) ** i] * 4, "x", 1) for i in range(40)]
    kept, dims, model = wh.fitted(spark.createDataFrame(rows, SCHEMA))
    assert {r.deviation for r in wh.whitened(kept, dims, model).collect()} == {None}


def test_one_vector_and_none(spark):
    kept, dims, model = wh.fitted(spark.createDataFrame([(1, [1.0, 2.0], "x", 1)] * 3, SCHEMA))
    assert len(model.values) == 0 and wh.identity_error(kept, dims, model) == 0
    assert [r.white for r in wh.whitened(kept, dims, model).collect()] == [[]] * 3
    for rows in ([], [(1, None, "x", 1)]):
        assert wh.fitted(spark.createDataFrame(rows, SCHEMA))[1:] == (0, None)


def test_query(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(40)]) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = wh.op13_whitening(spark, str(tmp_path)).collect()
    assert len(found) == 3200 and {r.component for r in found} == set(range(1, 33))
    assert {r.n for r in found} == {100} and max(r.identity_error for r in found) < 1e-9
    firsts = {r.component: r.explained for r in found}
    assert [firsts[c] for c in range(1, 33)] == sorted(firsts.values(), reverse=True)
    empty = tmp_path / "none"
    frame.limit(0).write.parquet(str(empty / "embeddings.parquet"))
    none = wh.op13_whitening(spark, str(empty))
    assert none.collect() == [] and set(none.columns) == set(found[0].asDict())

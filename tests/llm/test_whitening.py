"""Whitening against a dense solver; updates against the matrices they stand for."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from framepair.llm import whitening as W

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("X", T.StringType())])


def dense(d, q):
    return (q * d[:, None, :]) @ q.transpose(0, 2, 1)


@pytest.mark.parametrize("m", [1, 2, 7, 32])
@pytest.mark.parametrize("kind", ["plain", "tied", "sparse", "zero", "tiny"])
def test_updates_of_a_stack(m, kind):
    r = np.random.default_rng(m)
    d = np.sort(r.integers(0, 3, (6, m)).astype(float) if kind == "tied" else r.exponential(10, (6, m)), 1)
    q = np.linalg.qr(r.normal(size=(6, m, m)))[0]
    v = r.normal(size=(6, m))
    if kind == "sparse":
        v = (q[:, :, :1] @ np.ones((1, 1)))[:, :, 0]  # touches a single pole
    rho = np.zeros(6) if kind == "zero" else np.full(6, 1e-18 if kind == "tiny" else 3.0)
    e, p = W.update(d, q, v, rho)
    want = dense(d, q) + rho[:, None, None] * v[:, :, None] * v[:, None, :]
    assert np.abs(dense(e, p) - want).max() < 1e-12 * max(1, np.abs(want).max())
    assert np.abs(p.transpose(0, 2, 1) @ p - np.eye(m)).max() < 1e-13 and (np.diff(e) >= 0).all()


def test_spectra_of_vectors_and_their_combination():
    r = np.random.default_rng(1)
    for m, n, lanes in ((6, 50, 4), (6, 3, 4), (3, 40, 7)):
        x = r.integers(-20, 20, (n, m))
        s = W.Spectra.empty(lanes, m)
        for lo in range(0, n, lanes):
            s.add(x[lo : lo + lanes])
        one = W.from_bytes(s.folded().to_bytes(), m)
        apart = x - x.mean(0)
        assert np.abs(dense(one.d, one.q)[0] - apart.T @ apart).max() < 1e-9 * max(1, (apart**2).sum())
        assert one.n[0] == n and (one.total[0] == x.sum(0)).all() and np.allclose(one.mean[0], x.mean(0))


def expected(rows, components=16):
    sound = [(i, v) for i, v in rows if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)]
    x = {tuple(int(np.floor(np.float64(np.float32(e)) * 64)) + 1_000_000 for e in v) for _, v in sound}
    fit = np.array(sorted(x), dtype=np.int64)
    n, total = len(fit), fit.sum(0)
    c = (n * fit - total) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return sound, n, total, values[::-1], vectors[:, ::-1]


def check(done, model, rows):
    sound, n, total, values, vectors = expected(rows)
    got = done.collect()
    assert len(got) == len(sound) and model.n == n and model.identity_error < 1e-9
    k = len(model.values)
    assert np.allclose(model.values, values[:k], rtol=1e-10) and np.isclose(model.trace, values.sum(), rtol=1e-10)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    sign = np.sign((model.vectors * vectors[:, :k]).sum(0))
    for i, v in sound:
        x = [int(np.floor(np.float64(np.float32(e)) * 64)) + 1_000_000 for e in v]
        y = np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, total)]) @ vectors[:, :k] / np.sqrt(values[:k]) * sign
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
        assert any(np.allclose(r._whitened, y, rtol=1e-7, atol=1e-7) and r.deviation == deviation for r in by_id[i])


def test_rows_with_faults_copies_and_a_clashing_column(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(e) for e in r.normal(0, [1, 0.5, 2, 0.1, 3], 5)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector in most rows
    rows += [(7, rows[3][1]), (None, rows[4][1]), (1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf")] * 5)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], VECTORS).withColumnRenamed("X", "Whitened").repartition(7)
    done, model = W.whiten(df)
    assert done.columns == ["vec_id", "embedding", "Whitened", "_whitened", "deviation"] and len(model.values) == 5
    check(done, model, rows)


def test_other_lengths_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 5.0]), (3, [0.5, 0.0]), (4, [1.0]), (5, []), (6, [9.0, 9.0])]
    done, model = W.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS))
    assert {r.vec_id for r in done.collect()} == {1, 2, 3, 6} and model.n == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_is_no_component(spark, rows):
    done, model = W.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS))
    assert model is None and done.count() == 0


def test_flat_directions_are_no_components(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, 1.0]) for i in range(30)]
    done, model = W.whiten(spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS))
    assert len(model.values) == 1 and model.identity_error < 1e-9 and len(done.first()["whitened"]) == 1


def test_a_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 31, 0], [1, 1], [1, 0]], np.int64)
    assert W.deviations(x, 1 << 31, np.zeros(2, np.int64)) == [None, None, 1 << 62]


def test_query_over_the_table(spark):
    from framepair.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    sound, n, total, values, vectors = expected(rows)
    got = QUERIES["op11_whitening"](spark, sf).collect()
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(sound) * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    y = {i: ((n * np.array([int(np.floor(float(e) * 64)) + 1_000_000 for e in v]) - total) / n) @ vectors[:, :k] / np.sqrt(values[:k]) for i, v in sound}
    for r in got:
        assert abs(abs(r.whitened) - abs(y[r.vec_id][r.component - 1])) < 1e-6
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-6

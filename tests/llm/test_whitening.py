import math

import numpy as np
import pytest

from shelfline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string"


def by_hand(vectors):
    """n, deviations, covariance of the whole-number vectors, in Python's own numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    nx = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    y = np.array([[v / n for v in row] for row in nx])
    return n, [sum(v * v for v in row) for row in nx], y, y.T @ y / n


def check(rows, vectors, components=32):
    n, deviations, y, covariance = by_hand([v for _, v in vectors])
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int(np.sum(values > 1e-10 * values.sum())))
    assert len(rows) == len(vectors) * k
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[found[i][c + 1].whitened for c in range(k)] for i, _ in vectors])
    expected = y @ basis[:, :k] / np.sqrt(values[:k])
    signs = np.sign(np.sum(w * expected, axis=0))
    np.testing.assert_allclose(w * signs, expected, atol=1e-7)
    for (i, _), deviation in zip(vectors, deviations, strict=True):
        r = found[i][1]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-8
        np.testing.assert_allclose([found[i][c + 1].explained for c in range(k)], values[:k] / values.sum(), rtol=1e-9)


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "z") for i, v in vectors], SCHEMA)


def correlated(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(0.5, 4, d)) @ rng.standard_normal((d, d)) / np.sqrt(d) + 3


def test_against_a_dense_solution(spark):
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(correlated(150, 40))]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_fewer_dimensions_than_components_and_a_constant_one(spark):
    vectors = [(i, [float(v[0]), 5.0, float(v[1]), -2.5]) for i, v in enumerate(correlated(60, 2))]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_odd_rows_take_no_part(spark):
    good = [(i, [float(x) for x in v]) for i, v in enumerate(correlated(30, 3))]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [1.0, float("-inf"), 1.0]), (104, [1.0, 2.0]), (105, [])]
    repeated = good + good[:4]
    rows = whitening.whiten(table(spark, [*repeated, *odd])).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good} and len(rows) == 34 * 3
    n, deviations, _, _ = by_hand([v for _, v in repeated])
    assert {(r.vec_id, r.n, r.deviation) for r in rows} == {(i, n, d) for (i, _), d in zip(repeated, deviations, strict=True)}


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]])
def test_nothing_to_whiten(spark, vectors):
    out = whitening.whiten(table(spark, vectors))
    assert out.collect() == [] and out.columns[-1] == "identity_error"


def test_null_ids_stay(spark):
    rows = whitening.whiten(table(spark, [(None, [1.0, 2.0]), (None, [2.0, 4.5]), (3, [4.0, -1.0])])).collect()
    assert sum(r.vec_id is None for r in rows) == 4 and len(rows) == 6


def test_deviation_is_exact_or_null():
    x = np.array([[5_000_000_000, 1], [0, 0], [1, 7]])
    sums, n = x.sum(axis=0), 3
    assert whitening._deviations(x, sums, n) == [None, None, None]
    x = x // 10
    sums = x.sum(axis=0)
    exact = [int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True))) for row in x]
    assert whitening._deviations(x, sums, n) == [v if v < 1 << 63 else None for v in exact] and exact[1] < 1 << 63


@pytest.mark.parametrize("width, wanted, space", [(120, 8, 24), (60, 32, None), (150, 1, None)])
def test_eigenpairs_of_a_dense_operator(width, wanted, space):
    """Small search spaces restart and lock; equal eigenvalues are found as often as they occur."""
    rng = np.random.default_rng(width)
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    spectrum = np.sort(rng.random(width))[::-1] ** 2
    spectrum[1] = spectrum[2] = spectrum[3]
    operator = (turn * spectrum) @ turn.T
    values, vectors = whitening.eigenpairs(lambda q: operator @ q, width, wanted, space=space)
    np.testing.assert_allclose(values, np.sort(spectrum)[::-1][:wanted], atol=1e-12)
    np.testing.assert_allclose(operator @ vectors, vectors * values, atol=2e-13)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = rng.standard_normal((30, 4))
    shift = np.array([0.0, 1.0, -2.0, 3.0])
    found = whitening.minres(lambda t: a @ t - t * shift, right, 60, enough=1e-12)
    np.testing.assert_allclose(a @ found - found * shift, right, atol=1e-6)


def test_query(spark, sf_dir):
    rows = queries.op13_whitening(spark, sf_dir).collect()
    vectors = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    check(rows, vectors)

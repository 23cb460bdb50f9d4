"""Operator 13 against a dense solver and exact arithmetic."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening
from lodestone.llm.queries.op13_query import op13_embedding_whitening

ROWS = "vec_id long, embedding array<float>"


def quantised(vectors) -> list[tuple]:
    return [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors]


def held(rows, vectors, components: int) -> None:
    """Rows of the operator against the distinct vectors, by numpy's solver; signs are free."""
    x = quantised(vectors)
    d = np.array(sorted(set(x)), float)
    n, sums = len(d), [sum(v[i] for v in set(x)) for i in range(d.shape[1])]
    centred = d - d.mean(axis=0)
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    k = min(components, d.shape[1])
    assert len(got) == len(rows) == len(x) * k
    for c in range(k):
        want = (np.array(x, float) - d.mean(axis=0)) @ directions[:, c] / np.sqrt(values[c])
        own = np.array([got[i, c + 1].whitened for i in range(len(x))])
        own *= np.sign(own @ want)
        np.testing.assert_allclose(own, want, rtol=1e-7, atol=1e-7)
        assert abs(got[0, c + 1].explained / (values[c] / np.trace(v)) - 1) < 1e-9
    for i, xi in enumerate(x):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(xi, sums, strict=True)) and got[i, 1].n == n
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_rows_with_copies(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    vectors = [[float(v) for v in mix @ rng.normal(size=6)] for _ in range(150)]
    vectors += vectors[:1] * 90 + vectors[5:20]
    df = spark.createDataFrame(list(enumerate(vectors)), ROWS).repartition(4)
    held(whitening.whiten(df).collect(), vectors, 4)
    assert sorted(map(tuple, whitening.whiten(df).drop("identity_error").collect())) == sorted(map(tuple, whitening.whiten(df.repartition(2)).drop("identity_error").collect()))


def test_jacobi_against_a_dense_solver():
    rng = np.random.default_rng(2)
    for dims in (1, 2, 3, 7, 16, 33):
        a = rng.normal(size=(dims, dims))
        a = a @ a.T
        values, u = whitening.jacobi(a)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10)
        np.testing.assert_allclose(u.T @ u, np.eye(dims), atol=1e-13)
        np.testing.assert_allclose(u @ np.diag(values) @ u.T, a, atol=1e-11 * values[0])
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.jacobi(np.ones((4, 4)))[0].round(12).tolist() == [4, 0, 0, 0]
    assert whitening.jacobi(np.diag([1.0, 5.0, 3.0]))[0].tolist() == [5, 3, 1]


def test_small_eigenvalues_are_accurate():
    """A graded matrix: the least eigenvalue, 1e-12 of the largest, to twelve digits of its own."""
    scale = np.diag([1.0, 1e-2, 1e-4, 1e-6])
    core = np.array([[1, 0.3, 0.2, 0.1], [0.3, 1, 0.3, 0.2], [0.2, 0.3, 1, 0.3], [0.1, 0.2, 0.3, 1]])
    a = scale @ core @ scale
    values, _ = whitening.jacobi(a)
    product = Fraction(1)
    for v in values:
        product *= Fraction(float(v))
    det = Fraction(1)
    m = [[Fraction(float(x)) for x in row] for row in a]
    for i in range(4):
        det *= m[i][i]
        for j in range(i + 1, 4):
            factor = m[j][i] / m[i][i]
            m[j] = [x - factor * y for x, y in zip(m[j], m[i], strict=True)]
    assert abs(product / det - 1) < Fraction(1, 10**12) and values[-1] < 1.1e-12


def test_scatter_is_exact(spark):
    """Far from zero, where sums of products in doubles lose digits."""
    rng = np.random.default_rng(3)
    x = [[int(v) + 40_000_000 for v in rng.integers(-9, 9, 3)] for _ in range(200)]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>").distinct()
    model = whitening.fit_whitening(fit)
    rows = sorted({tuple(v) for v in x})
    n = len(rows)
    trace = sum((Fraction(sum(r[i] ** 2 for r in rows), n) - Fraction(sum(r[i] for r in rows), n) ** 2) for i in range(3))
    assert abs(Fraction(model.trace) / trace - 1) < Fraction(1, 10**14)
    assert whitening.products(np.array([[1 << 40, -3], [5, 7]])).tolist() == [[(1 << 80) + 25, -3 * (1 << 40) + 35], [-3 * (1 << 40) + 35, 58]]


def test_a_component_without_variance(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 2.0, float(i % 3)]) for i in range(30)], ROWS)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 90 and {r.whitened for r in rows if r.component == 3} == {None}
    assert {r.explained for r in rows if r.component == 3} == {0.0} and rows[0].identity_error < 1e-12
    one = whitening.whiten(df.limit(1)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)]


def test_messy_rows_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, -1.0]), (2, [-0.0, 0.0]), (3, [1.0]), (4, [])]
    bad = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 0.0]), (9, [-inf, 0.0])]
    df = spark.createDataFrame(good + bad, ROWS).withColumns({"x": F.lit("q"), "n": F.lit(0), "component": F.lit(1)})
    rows = whitening.whiten(df).collect()
    # Filled with zeros, the last three are (0, 0), (256, 0) and (0, 0).
    assert sorted((r.vec_id or 0) for r in rows) == sorted([1, 1, 0, 2, 3, 4] * 2) and {r.n for r in rows} == {4}
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], ROWS)).count() == 0


def test_deviations_that_need_more_than_a_long():
    model = whitening.Whitening(3, (1, -2), 1.0, np.ones(2), np.eye(2))
    big = (1 << 33) + 1
    assert model.deviations(np.array([[big, 0]])) == [None]
    assert model.deviations(np.array([[1 << 29, 5]])) == [(3 * (1 << 29) - 1) ** 2 + 17**2]


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMS", 3)
    with pytest.raises(ValueError, match="4 dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * 4)], ROWS))


def test_the_query(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    held(op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [r.embedding for r in data], 4)

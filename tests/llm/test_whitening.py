"""Whitening against plain whole-number and floating-point arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cairnflow.llm import charpoly, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, key string"


def plain(rows):
    """vec_id to (n, deviation), and eigenvalues and covariance of the distinct vectors, by other means."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = sorted({tuple(v) for _, v in good})
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in good}
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(c - m) for c, m in zip(v, mean)] for v in x])
    white = {i: np.array([float(c - m) for c, m in zip(v, mean)]) for i, v in good}
    return n, deviation, np.linalg.eigh(centred.T @ centred / n), white


def test_equals_plain_arithmetic(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=9) * np.arange(1, 10)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    rows += [(2000, None), (2001, [None] * 9), (2002, [float("nan")] + [0.0] * 8), (2003, [float("inf")] * 9), (2004, [1.0] * 8), (2005, []), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(5)
    got = whitening.transform(df, whitening.fit(df)).collect()
    usable = [(i, v) for i, v in rows if v is not None and len(v) == 9]
    n, deviation, (values, vectors), white = plain(usable)
    values, vectors = values[::-1], vectors.T[::-1]
    assert len(got) == 9 * len(deviation) and {g.n for g in got} == {n}
    signs = {}
    for g in got:
        k = g.component - 1
        assert g.deviation == deviation[g.vec_id]
        assert g.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        want = white[g.vec_id] @ vectors[k] / math.sqrt(values[k])
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * g.whitened))
            assert g.whitened * signs[k] == pytest.approx(want, rel=1e-6)
    assert 0 <= got[0].identity_error < 1e-10 and len({g.identity_error for g in got}) == 1


@pytest.mark.parametrize("values", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[None]]])
def test_without_variance_there_are_no_rows(spark, values):
    df = spark.createDataFrame([(i, v, 1, "", "") for i, v in enumerate(values)], SCHEMA)
    assert whitening.transform(df, whitening.fit(df)).count() == 0


def test_fewer_dimensions_than_components(spark):
    """Vectors on a line in three dimensions: one component, whatever its size."""
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1, "", "") for i in range(4)], SCHEMA)
    got = whitening.transform(df, whitening.fit(df)).collect()
    assert {g.component for g in got} == {1} and got[0].explained == 1.0
    assert np.var([g.whitened for g in got]) == pytest.approx(1)


def test_equal_variances_give_orthonormal_components(spark):
    rows = [(2 * k + s, [3.0 * (1 - 2 * s) if j == k else 0.0 for j in range(5)], 1, "", "") for k in range(5) for s in (0, 1)]
    model = whitening.fit(spark.createDataFrame(rows, SCHEMA))
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(5), atol=1e-14) and model.identity_error < 1e-12


def test_values_as_large_as_a_long(spark):
    """Doubles whose whole numbers need several parts; a deviation that is no long is null."""
    rows = [(i, [c * 1e16, -c * 3.5e15, float(i)]) for i, c in enumerate([1.0, -0.5, 0.25, 2.0])]
    rows.append((9, [1e300, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows[:4]]
    assert model.n == 4 and model.sums == [sum(c) for c in zip(*x)]
    got = whitening.transform(df, model).collect()
    assert {g.vec_id for g in got} == {0, 1, 2, 3} and all(g.deviation is None for g in got)
    assert model.identity_error < 1e-6


def test_polynomial_is_exact():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        half = r.integers(-9, 9, (n + 3, n)).astype(object)
        m = half.T @ half
        primes = charpoly.enough_primes(int(np.trace(m)), n)
        poly = charpoly.combined([charpoly.polynomial_mod(m, p) for p in primes], primes)
        for at in (-3, 0, 7):
            a = [[Fraction(int(at * (i == j) - m[i, j])) for j in range(n)] for i in range(n)]
            value = Fraction(1)
            for j in range(n):
                pivot = next((i for i in range(j, n) if a[i][j]), None)
                if pivot is None:
                    value = Fraction(0)
                    break
                if pivot != j:
                    a[j], a[pivot], value = a[pivot], a[j], -value
                value *= a[j][j]
                for i in range(j + 1, n):
                    f = a[i][j] / a[j][j]
                    a[i] = [x - f * y for x, y in zip(a[i], a[j])]
            assert sum(c * at**k for k, c in enumerate(poly)) == value


def test_roots_with_multiplicities():
    poly = [1]
    for root in (0, 0, 3, 3, 3, 5, 1000, 1001):
        poly = [b - root * a for a, b in zip([*poly, 0], [0, *poly])]
    roots = charpoly.Roots(poly, 2015, 99)
    assert roots.rank == 6
    assert [(round(r / (1 << roots.shift), 9), many) for r, many in roots.found] == [(1001, 1), (1000, 1), (5, 1), (3, 3)]
    assert [many for _, many in charpoly.Roots(poly, 2015, 2).found] == [1, 1]

"""Whitening against exact fractions and plain double-precision eigenvectors."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from evidar.llm import whitening


def table(spark, vectors, extra=False):
    kind = "vec_id long, embedding array<double>" + (", id string, v string, w int, whitened double" if extra else "")
    rows = [(k, None if v is None else [None if e is None else float(e) for e in v]) + (("a", "b", 1, 2.0) if extra else ()) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, kind)


def brute(vectors):
    """n, exact covariance and deviations of usable vectors, in fractions."""
    x = [[int(np.floor(1024 * e)) + 100_000 for e in v] for v in vectors]
    n, width = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(width)]
    d = [[n * r[k] - s[k] for k in range(width)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(width)] for i in range(width)]
    return n, np.array(cov, object), [sum(e * e for e in r) for r in d], np.array([[Fraction(e, n) for e in r] for r in d], object)


def test_equals_exact_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).tolist()
    n, cov, deviations, centred = brute(vectors)
    model = whitening.fit(table(spark, vectors))
    assert model.n == n
    assert model.trace == float(sum(cov[k, k] for k in range(6)))
    for k in range(6):
        v = model.vectors[:, k]
        residual = [float(sum(cov[i, j] * Fraction(v[j]) for j in range(6)) - Fraction(float(model.values[k])) * Fraction(v[i])) for i in range(6)]
        assert max(map(abs, residual)) <= 4e-15 * float(model.values[0])
        assert abs(float(sum(Fraction(e) ** 2 for e in v)) - 1) < 4e-16
    found = whitening.whiten(table(spark, vectors), model, 4).orderBy("id").collect()
    assert [r["deviation"] for r in found] == [Decimal(d) for d in deviations]
    want = np.array([[float(sum(row[j] * Fraction(model.vectors[j, k]) for j in range(6))) for k in range(4)] for row in centred]) / np.sqrt(model.values[:4])
    assert np.abs(np.array([r["whitened"] for r in found]) - want).max() < 1e-13
    assert whitening.identity_error(whitening.whiten(table(spark, vectors), model, 6)) < 1e-12


@pytest.mark.parametrize("gap", [1e-3, 1e-9, 1e-13, 0.0])
def test_clustered_eigenvalues(gap):
    """Eigenvalues that single precision cannot tell apart are still resolved."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(12) - 0.5 * (q.T @ q))
    values = np.array([7, 5 + gap, 5, 5 - 2 * gap, 3, 3 - gap, 2, 1, 0.5, 0.25, 0.125, 0], np.longdouble)
    found, x = whitening.eigenvectors((q * values) @ q.T)
    assert np.abs(found - values).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-17
    a = (q * values) @ q.T
    assert np.abs(a @ x - x * found).max() < 3e-18 * 7
    if gap >= 1e-9:
        assert np.abs(np.abs((q * x).sum(0)) - 1).max() < 1e-12


def test_awkward_vectors(spark):
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1e300, 1.0], [1.0, 2.0, 3.0]]
    good = [[0.5, 0.25], [0.5, 0.25], [-1.0, 2.0], [3.0, 0.125]]
    df = table(spark, bad + good, extra=True)
    model = whitening.fit(df)
    assert model.n == 4
    assert sorted(r["id"] for r in whitening.whiten(df, model).collect()) == [7, 8, 9, 10]
    assert whitening.fit(table(spark, bad[:6])) is None
    assert whitening.fit(table(spark, [])) is None
    assert whitening.whiten(table(spark, []), None).collect() == []


def test_equal_vectors_have_no_whitened_value(spark):
    df = table(spark, [[1.0, 2.0]] * 3)
    model = whitening.fit(df)
    found = whitening.whiten(df, model)
    assert [(r["deviation"], r["whitened"]) for r in found.collect()] == [(0, [None, None])] * 3
    assert whitening.identity_error(found) is None


def test_line_in_the_plane_has_one_component(spark):
    df = table(spark, [[float(k), 2.0 * k] for k in range(9)])
    found = whitening.whiten(df, whitening.fit(df)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1] is None for r in found)


def test_large_entries_stay_exact(spark):
    vectors = [[float(1 << 29), 1.0], [-float(1 << 29), 3.0], [7.0, -float(1 << 28)]]
    n, cov, deviations, _ = brute(vectors)
    model = whitening.fit(table(spark, vectors))
    assert model.trace == float(cov[0, 0] + cov[1, 1])
    assert [int(r["deviation"]) for r in whitening.whiten(table(spark, vectors), model).orderBy("id").collect()] == deviations


def test_query(spark):
    found = whitening.op13_embedding_whitening(spark, "/root/testdata/sf0.01")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found.collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()])) + 100_000
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    whole = (x - x.mean(0)) @ vector[:, ::-1][:, :8] / np.sqrt(value[::-1][:8])
    got = np.zeros_like(whole)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((got * whole).sum(0))
    assert len(rows) == 8 * len(x)
    assert np.abs(got - whole * sign).max() < 1e-9
    assert {round(r["explained"], 12) for r in rows} == {round(float(e / value.sum()), 12) for e in value[::-1][:8]}
    assert max(r["identity_error"] for r in rows) < 1e-10
    assert {r["n"] for r in rows} == {len(x)}

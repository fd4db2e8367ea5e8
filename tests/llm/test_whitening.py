"""Whitening against numpy's own eigenvalue routine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, own int, deviation string, whitened int, v int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "d", 2, 3) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, k):
    """x, S, eigenvalues and components by numpy."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 64).astype(int) + 1_000_000
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / len(x))
    return x, values[::-1][:k], vectors[:, ::-1][:, :k]


def random_symmetric(rng, d, kind):
    a = rng.standard_normal((d, d))
    if kind == "equal":  # clusters of equal eigenvalues
        q, _ = np.linalg.qr(a)
        return q @ np.diag(np.repeat([5.0, 3.0, 1.0, 0.5], d)[:d]) @ q.T
    if kind == "blocks":
        a = np.zeros((d, d))
        a[: d // 2, : d // 2] = 2.0 * np.eye(d // 2)
        a[d // 2 :, d // 2 :] = 1.0 + np.eye(d - d // 2)
        return a
    return a @ a.T if kind == "full" else a[:, :2] @ a[:, :2].T


@pytest.mark.parametrize("kind", ["full", "equal", "blocks", "low rank"])
@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_eigenpairs(kind, d):
    a = random_symmetric(np.random.default_rng(d), d, kind)
    values, vectors = W.leading_eigenpairs(a, min(d, 32))
    true = np.linalg.eigvalsh(a)[::-1][: len(values)]
    assert np.abs(values - true).max() <= 1e-12 * abs(true[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * true[0]
    if kind == "low rank":
        assert len(values) == min(2, d)


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[3, 17]] = 0.0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 57)
    assert W.sturm_counts(d, e * e, at, 1e-300).tolist() == [(true < a).sum() for a in at]


def test_elimination():
    rng = np.random.default_rng(6)
    d, e, b = rng.standard_normal(25), 10 * rng.standard_normal(24), rng.standard_normal(25)
    a = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(a @ W.solved_tridiagonal(d, e, 0.0, b, 1e-300), b)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 9)) @ rng.standard_normal((9, 9)) + rng.standard_normal(9) * 30).astype(np.float32)
    vectors[50] = vectors[51]
    rows = list(enumerate(vectors.tolist())) + [(400, None), (401, [None] * 9), (402, [math.nan] * 9), (403, [math.inf] + [0.0] * 8), (404, [1.0] * 8), (405, []), (406, [1e38] * 9)]
    out, model, error = W.whitened(table(spark, rows), components=5)
    x, values, components = plain(vectors, 5)
    assert model.n == 300 and model.sums == x.sum(axis=0).tolist()
    assert np.allclose(model.values, values, rtol=1e-12) and np.allclose(model.explained, values / plain(vectors, 9)[1].sum(), rtol=1e-12)
    assert error < 1e-12
    found = {r["own"]["vec_id"]: r for r in out.collect()}
    assert sorted(found) == list(range(300))
    white = np.array([found[i]["whitened"] for i in range(300)])
    expected = (x - x.mean(axis=0)) @ components / np.sqrt(values)
    sign = np.sign((white * expected).sum(axis=0))
    assert np.abs(white * sign - expected).max() < 1e-9
    deviation = [sum((300 * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0))) for row in x]
    assert [found[i]["deviation"] for i in range(300)] == deviation
    assert found[7]["own"]["whitened"] == 2 and found[7]["own"]["v"] == 3


def test_exact_beyond_64_bits():
    x = np.array([[2**60, 3], [2**60 + 5, -7], [-(2**60), 0], [9, 9]])
    assert W.exact_sums(x) == [2**60 + 14, 5]
    sums = [sum(int(v) for v in x[:, j]) for j in range(2)]
    assert W.deviations(x, 4, sums) == [None] * 4
    small = np.array([[1_000_064, 999_000], [1_000_001, 1_000_000]])
    n, sums = 10**7, [10**7 * 1_000_000 + 3, 10**7 * 999_500 + 1]
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in small]
    assert W.deviations(small, n, sums) == [v if v < 2**63 else None for v in exact]


def test_degenerate_tables(spark):
    for vectors, n, k in (([], 0, 0), ([(1, None)], 0, 0), ([(1, [1.0, 2.0])], 1, 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 2, 0), ([(1, [1.0, 2.0]), (1, [1.0, 5.0]), (None, [1.0, 2.0])], 3, 1)):
        out, model, error = W.whitened(table(spark, vectors))
        assert model.n == n and len(model.values) == k and error < 1e-9
        got = out.collect()
        assert len(got) == n and all(len(r["whitened"]) == k for r in got)
    with pytest.raises(ValueError):
        W.fitted(spark.createDataFrame([([0.5] * (W.MOST_DIMENSIONS + 1),)], "v array<double>"))


def test_query_contract(spark, sf_dir):
    rows = W.op11_sturm_whitening(spark, sf_dir)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert rows.count() == 32 * table.where("embedding is not null").count()
    vectors = [r[0] for r in table.orderBy("vec_id").select("embedding").collect()]
    x, values, components = plain(vectors, 32)
    got = rows.groupBy("component").agg(F.max("explained").alias("e"), F.max("identity_error").alias("i"), F.avg("whitened").alias("m")).orderBy("component").collect()
    total = ((x - x.mean(axis=0)) ** 2).sum() / len(x)
    assert np.allclose([r["e"] for r in got], values / total, rtol=1e-10)
    assert max(r["i"] for r in got) < 1e-9 and max(abs(r["m"]) for r in got) < 1e-9

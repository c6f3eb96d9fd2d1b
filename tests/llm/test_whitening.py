"""Embedding whitening against numpy's own eigenvalues and exact arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnclean.llm.whitening import exact_products, fit_whitening, leading_eigen, op11_embedding_whitening, positive_pivots, whiten

KINDS = [lambda r, n: r.random(n) * 100, lambda r, n: np.round(r.random(n) * 3), lambda r, n: np.full(n, 7.0),
         lambda r, n: 10.0 ** -np.arange(n), lambda r, n: 5 + 1e-11 * np.arange(n), lambda r, n: r.standard_normal(n)]


@pytest.mark.parametrize("kind", range(len(KINDS)))
def test_leading_eigenvalues(kind):
    rng = np.random.default_rng(kind)
    for _ in range(15):
        n = int(rng.integers(1, 40))
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = (q * KINDS[kind](rng, n)) @ q.T
        v = (v + v.T) / 2
        e, x = leading_eigen(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        size = max(1, np.abs(want).max())
        assert np.abs(e - want[:16]).max() < 1e-12 * size
        assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-12 * size
        for shift in rng.random(5) * 100:
            assert positive_pivots(v - shift * np.eye(n)) == (want > shift).sum()


def test_pivots_of_indefinite_matrices():
    assert positive_pivots(np.array([[0.0, 1], [1, 0]])) == 1
    assert positive_pivots(np.zeros((3, 3))) == 0
    assert positive_pivots(np.diag([1.0, -1, 0, 2])) == 2


def test_products_of_large_numbers_are_exact():
    rng = np.random.default_rng(0)
    for most in (10, 2 ** 20, 2 ** 30, 2 ** 52):
        y = rng.integers(-most, most, (50, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (exact_products(y) == want).all()


def brute(vectors):
    """Per kept vector: (x, deviation); and n, covariance, all with Python's whole numbers."""
    xs = [tuple(math.floor(64 * float(c)) + 1000000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(x, s)) for x in xs]
    off = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    return xs, dev, n, s, off.T @ off / n


def check(rows, ids, vectors):
    xs, dev, n, s, v = brute(vectors)
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[want > 1e-9 * want[0]][:16]
    k = len(want)
    assert len(rows) == len(ids) * k
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    signs = {}
    for i, x, e in zip(ids, xs, dev):
        own = sorted(by[i], key=lambda r: r["component"])[:k] if i is not None else []
        for r in own:
            assert r["n"] == n and r["deviation"] == e and r["identity_error"] < 1e-10
            assert abs(r["explained"] - want[r["component"] - 1] / np.trace(v)) < 1e-10
    w, vec = np.linalg.eigh(v)
    order = np.argsort(w)[::-1][:k]
    proj = (np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in xs]) @ vec[:, order]) / np.sqrt(w[order])
    for j in range(k):
        if (j and want[j - 1] - want[j] < 1e-3 * want[0]) or (j + 1 < k and want[j] - want[j + 1] < 1e-3 * want[0]):
            continue                  # nearly equal eigenvalues: vectors are not settled
        got = np.array([next(r["whitened"] for r in by[i] if r["component"] == j + 1) for i in ids])
        assert min(np.abs(got - proj[:, j]).max(), np.abs(got + proj[:, j]).max()) < 1e-8


def test_query_over_given_embeddings(spark):
    d = "/root/testdata/sf0.001"
    got = op11_embedding_whitening(spark, d)
    assert got.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                              ("explained", "double"), ("identity_error", "double")]
    src = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    check(got.collect(), [r["vec_id"] for r in src], [r["embedding"] for r in src])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.standard_normal(3) * (1, 5, 9)] for _ in range(40)]
    rows = [(i, v, 0.0) for i, v in enumerate(good)]
    rows += [(100 + i, good[0], 1.0) for i in range(60)]                       # one vector in many rows
    rows += [(200, None, 0.0), (201, [1.0, None, 2.0], 0.0), (202, [1.0, float("nan"), 2.0], 0.0), (203, [float("inf"), 0.0, 0.0], 0.0),
             (204, [1.0], 0.0), (205, [], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(5)
    got = whiten(df, fit_whitening(df)).collect()
    check(got, [r[0] for r in rows[:100]], [r[1] for r in rows[:100]])


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = whiten(df, fit_whitening(df)).groupBy("vec_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).collect()
    assert {r["vec_id"]: (r["c"], r["n"]) for r in got} == {None: (4, 3), 7: (4, 3)}


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert whiten(df, fit_whitening(df)).collect() == []


def test_very_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<double>")
    got = whiten(df, fit_whitening(df)).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] in (1, 2))
    assert all(math.isfinite(r["whitened"]) for r in got)

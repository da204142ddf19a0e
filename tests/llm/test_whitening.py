"""Whitening against numpy's own eigenvalues, on the given vectors and on odd ones."""

import math

import numpy as np
import pytest

from sessionloom.llm import whitening
from sessionloom.llm.queries import QUERIES


def plain(rows):
    """vec_id -> (deviation, centred vector), eigenvalues, eigenvectors, n."""
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[k] for _, x in good) for k in range(d)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in good]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, deviation, centred, values[::-1], vectors[:, ::-1], n


def check(got, rows, components=8):
    good, deviation, centred, values, vectors, n = plain(rows)
    own = sorted((r for r in got), key=lambda r: (r.component, r.vec_id))
    k = min(components, int((values > values[0] * 1e-10).sum()))
    assert len(own) == n * k and {r.component for r in own} == set(range(1, k + 1))
    order = sorted(range(n), key=lambda i: good[i][0])
    white = np.array([r.whitened for r in own]).reshape(k, n).T
    for c in range(k):
        mine = [r for r in own if r.component == c + 1]
        assert [int(r.deviation) for r in mine] == [deviation[i] for i in order]
        assert all(math.isclose(r.explained, values[c] / values.sum(), rel_tol=1e-9) for r in mine)
        want = centred[order] @ vectors[:, c] / math.sqrt(values[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-7
    found = np.abs((white - white.mean(0)).T @ (white - white.mean(0)) / n - np.eye(k)).max()
    assert {r.n for r in own} == {n} and all(abs(r.identity_error - found) < 1e-10 and r.identity_error < 1e-4 for r in own)


def test_query_against_numpy(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, folder).collect(), rows)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(500)]
    one = whitening.whiten(vectors(spark, rows).repartition(1)).collect()
    many = whitening.whiten(vectors(spark, rows).repartition(13)).collect()
    check(one, rows)
    key = lambda r: (r.component, r.vec_id)
    assert [(r.whitened, r.deviation) for r in sorted(one, key=key)] == [(r.whitened, r.deviation) for r in sorted(many, key=key)]


def test_unusable_vectors_go(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1.0] * 4), (107, [1e300, 0.0, 0.0])]
    df = vectors(spark, bad[:4] + good + bad[4:]).selectExpr("*", "1 AS n", "2 AS deviation", "3 AS _at", "4 AS whitened")
    check(whitening.whiten(df).collect(), good)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3) * [1e9, 1e3, 1]]) for i in range(30)]
    check(whitening.whiten(vectors(spark, rows), 1).collect(), rows, 1)


def test_fewer_dimensions_than_components(spark):
    rows = [(i, [float(i % 7), float(2 * (i % 7)), float(i % 3)]) for i in range(50)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    check(got, rows)
    assert {r.component for r in got} == {1, 2}


def test_repeats_missing_ids_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 2.0]), (2, [3.0, 1.0])]
    got = whitening.whiten(vectors(spark, rows, "float")).collect()
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == ["1", "1", "2", "None"]
    assert whitening.whiten(vectors(spark, [(1, [2.0, 2.0])] * 3)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_jacobi_on_the_factor(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 3 * d)) * np.logspace(0, 4, d)[:, None]
    values, vectors_ = whitening.eigen(a @ a.T)
    assert np.allclose(vectors_.T @ vectors_, np.eye(d), atol=1e-12)
    assert np.allclose(vectors_ * values @ vectors_.T, a @ a.T, rtol=1e-11, atol=1e-9)
    assert np.all(np.diff(values) <= 0)
    factor, order = whitening.pivoted_cholesky(a @ a.T)
    assert np.allclose(factor @ factor.T, (a @ a.T)[np.ix_(order, order)]) and np.allclose(np.triu(factor, 1), 0)

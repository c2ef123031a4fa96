"""Whitening against plain extended-precision sums and a Jacobi eigen-solver."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import whitening

SCHEMA = "vec_id long, label int, embedding array<double>"
WIDE = np.longdouble


def jacobi(matrix, sweeps=30):
    a, n = matrix.astype(WIDE), len(matrix)
    v = np.eye(n, dtype=WIDE)
    for _ in range(sweeps):
        if np.sqrt((np.triu(a, 1) ** 2).sum()) < 1e-21 * np.abs(a).max():
            break
        for p in range(n):
            for q in range(p + 1, n):
                if a[p, q] == 0:
                    continue
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.eye(n, dtype=WIDE)
                turn[p, p] = turn[q, q] = c
                turn[p, q], turn[q, p] = t * c, -t * c
                a, v = turn.T @ a @ turn, v @ turn
    order = np.argsort(-np.diag(a))
    return np.diag(a)[order], v[:, order]


def symmetric(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0].astype(WIDE)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values), dtype=WIDE) - 0.5 * (q.T @ q))
    a = q @ np.diag(np.array(values, dtype=WIDE)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [list(range(1, 13)), [5, 5 + 1e-9, 5 + 2e-9, 3, 3 + 1e-8, 1], [4, 4, 4, 2, 2, 1], [3, 1, 0, 0, 0], [1e6, 1, 1e-3, 1e-6], [1.0] * 5, [1 + 1e-7 * k for k in range(16)]],
)
def test_refined_eigenvectors(values):
    a = symmetric(values)
    d, x = whitening.refined(a)
    wanted, own = jacobi(a)
    scale = float(np.abs(a).max())
    assert np.abs(d - wanted).max() < 1e-17 * scale * len(values)
    assert np.abs(a @ x - x * d).max() < 1e-17 * scale
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-17
    gaps = np.diff(np.sort(np.array(values, dtype=float)))
    if gaps.min() > 1e-3 * scale:
        assert np.abs(np.abs((x * own).sum(axis=0)) - 1).max() < 1e-16


def brute(rows, components=32):
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, _, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    n, size = len(kept), len(kept[0][1])
    total = [sum(v[j] for _, v in kept) for j in range(size)]
    deviation = [sum((n * v[j] - total[j]) ** 2 for j in range(size)) for _, v in kept]
    y = np.array([[WIDE(n * v[j] - total[j]) / n for j in range(size)] for _, v in kept])
    matrix = y.T @ y / n
    values, vectors = jacobi(matrix)
    values, vectors = values[:components], vectors[:, :components]
    return [i for i, _ in kept], n, deviation, (y @ (vectors / np.sqrt(values))).astype(float), (values / np.trace(matrix)).astype(float)


def checked(spark, rows, extra=(), components=32):
    df = spark.createDataFrame(rows + list(extra), SCHEMA).repartition(3)
    for name in ["x", "id", "n", "slot", "whitened"]:
        df = df.withColumn(name, F.lit("x"))
    ids, n, deviation, white, explained = brute(rows, components)
    got = whitening.whiten(df, components=components).collect()
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(ids) and set(by_id) == set(ids)
    ours = np.array([by_id[i].whitened for i in ids])
    ours *= np.sign((ours * white).sum(axis=0))
    assert np.abs(ours - white).max() < 1e-10
    assert [int(by_id[i].deviation) for i in ids] == deviation
    assert all(r.n == n and np.allclose(r.explained, explained, rtol=1e-10) and r.identity_error < 1e-10 for r in got)
    long = whitening.long_form(whitening.whiten(df, components=components))
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert long.count() == len(ids) * min(components, white.shape[1])


def cloud(seed, n, size=6):
    rng = np.random.default_rng(seed)
    return [(int(i), int(i % 3), [float(x) for x in rng.standard_normal(size) * np.arange(1, size + 1) + 5]) for i in range(n)]


def test_equals_brute_force(spark):
    checked(spark, cloud(1, 200))


def test_fewer_components_and_unusable_rows(spark):
    bad = [(1000, 1, None), (1001, 1, []), (1002, 1, [float("nan")] * 6), (1003, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1004, 1, [float("inf")] * 6), (1005, 1, [1.0, 2.0]), (1006, 1, [1e300] * 6)]
    checked(spark, cloud(2, 80), bad, components=3)


def test_far_from_zero_and_one_vector_in_a_third_of_the_rows(spark):
    rows = [(i, label, [x + 100_000 for x in v] if i % 3 else [100_005.0] * 6) for i, label, v in cloud(3, 120)]
    checked(spark, rows)


def test_wide_entries_take_the_integer_path(spark):
    checked(spark, [(i, label, [x * 1e5 for x in v]) for i, label, v in cloud(4, 60)])


def test_no_variance_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, 1, [1.0, 2.0]) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    line = [(i, 1, [float(i), 2.0 * i]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert len(got) == 5 and all(len(r.whitened) == 1 for r in got)


def test_null_and_repeated_ids_are_rows(spark):
    rows = cloud(5, 30)
    df = spark.createDataFrame(rows + [(None, 1, rows[0][2]), (3, 1, rows[3][2])], SCHEMA)
    got = whitening.whiten(df).collect()
    assert len(got) == 32 and got[0].n == 32

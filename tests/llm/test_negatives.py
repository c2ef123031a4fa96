"""Hard negatives against a plain double loop."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor, positives=5, wanted=3, low=50, high=95):
    valid = [
        (i, k, label, [math.floor(256 * x) for x in v])
        for k, (i, label, v) in enumerate(rows)
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, k, label, v in valid:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, j, other) for b, j, other, w in valid if j != k)
        for s, p, _, _ in [r for r in scored if r[3] == label][:positives]:
            fits = [r for r in scored if r[3] != label and low * -s <= 100 * -r[0] <= high * -s][:wanted]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out)


def found(spark, rows, **named):
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, **named)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def cloud(seed, n, size=8, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((labels, size))
    label = rng.integers(0, labels, n)
    return [(int(i), int(label[i]), [float(x) for x in middle[label[i]] + spread * rng.standard_normal(size)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_equals_brute_force_in_many_blocks(spark, monkeypatch, spread):
    # small blocks, clusters and bundles, so that bounds rule blocks out and bundles are cut
    for name, value in [("BLOCK", 40), ("BUNDLE", 8), ("MEMBERS", 6), ("HEAD", 1)]:
        monkeypatch.setattr(negatives, name, value)
    rows = cloud(3, 400, spread=spread)
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_a_third_of_the_rows_are_one_vector(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 30)
    rows = cloud(5, 150)
    rows = [(i, label if i % 2 else 0, v if i % 3 else [0.5] * 8) for i, label, v in rows]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_nulls_zero_vectors_repeats_and_long_scores(spark):
    rows = cloud(7, 60)
    rows += [(5, 1, rows[5][2]), (5, 1, rows[5][2]), (None, 1, rows[1][2]), (70, None, rows[2][2]), (75, 1, None), (80, 1, [0.0] * 8)]
    rows += [(85, 1, [float("nan")] * 8), (90, 1, [None] * 8), (95, 1, [float("inf")] * 8), (100, 1, []), (105, 2, [0.0] * 8)]
    rows += [(110, 0, [1e5 * x for x in rows[3][2]]), (115, 0, [1e5 * x for x in rows[4][2]]), (116, 1, [0.7e5 * x for x in rows[4][2]])]
    assert found(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_other_lengths_and_huge_vectors_take_no_part(spark):
    rows = cloud(9, 40)
    extra = [(200, 1, [1.0, 2.0]), (205, 1, [1e300] * 8)]
    assert found(spark, rows + extra) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0, 2.0])]) == []
    rows = cloud(11, 50)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ["row", "anchor", "id", "size", "v", "home", "chunk", "score"]:
        df = df.withColumn(name, F.lit("x"))
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_walk_ends_early_on_clustered_vectors():
    # the bound alone rules out what lies far from the cluster
    centre = np.array([[1.0, 0.0]])
    near = negatives.bounds(np.array([[2.0, 0.1], [0.0, 5.0], [-3.0, 0.0]]), centre, np.array([0.1]))[:, 0]
    assert near[0] == pytest.approx(2.0, abs=0.01) and near[1] < 0.51 and near[2] < -2.9

"""Flow scores, metrics and importance against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import importance, metrics, scores

C = 4


@pytest.fixture(scope="module")
def data(spark):
    """Logits of very different magnitude, one flow with a third of the rows."""
    rng = np.random.default_rng(0)
    n = 400
    flow = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 20, n))
    logits = rng.normal(0, 1, (n, C)) * rng.choice([1, 50, 900], n)[:, None]
    label = rng.integers(0, C, n)
    weight = rng.normal(0, 1, n) * 300
    rows = [(int(i), int(flow[i]), [float(x) for x in logits[i]], int(label[i]), float(weight[i])) for i in range(n)]
    df = spark.createDataFrame(
        rows, "packet_id bigint, stream_id bigint, logits array<double>, label_id int, w double"
    ).repartition(5)
    return df, flow, logits, label, weight


def by_flow(df, column="scores", key="stream_id"):
    return {r[key]: np.array(r[column]) for r in df.collect()}


def soft(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def check(got, flow, want):
    assert set(got) == set(flow.tolist())
    for f in got:
        np.testing.assert_allclose(got[f], want(flow == f), rtol=1e-9, atol=1e-9)


def test_means(data):
    df, flow, logits, _, _ = data
    check(by_flow(scores.flow_mean(df, C)), flow, lambda m: logits[m].mean(axis=0))
    check(by_flow(scores.flow_mean(df, C, probabilities=True)), flow, lambda m: soft(logits[m]).mean(axis=0))


@pytest.mark.parametrize("temp", [0.3, 1.0, 20.0])
def test_soft_weighted(data, temp):
    df, flow, logits, _, _ = data
    check(
        by_flow(scores.flow_soft_weighted(df, C, temp)),
        flow,
        lambda m: (soft(logits[m].max(axis=1) / temp)[:, None] * logits[m]).sum(axis=0),
    )


def test_weighted_and_topk_and_logsumexp(data):
    df, flow, logits, _, weight = data
    check(by_flow(scores.flow_weighted(df, C, "w")), flow,
          lambda m: (soft(weight[m])[:, None] * logits[m]).sum(axis=0))

    def top(m):
        order = np.argsort(-logits[m].max(axis=1), kind="stable")[:5]
        return logits[m][order].mean(axis=0)

    check(by_flow(scores.flow_topk_mean(df, C, 5, "packet_id")), flow, top)

    def lse(m):
        x = logits[m]
        return x.max(axis=0) + np.log(np.exp(x - x.max(axis=0)).sum(axis=0)) - math.log(m.sum())

    check(by_flow(scores.flow_logsumexp(df)), flow, lse)


def test_pooling(data):
    df, flow, logits, _, weight = data
    pool = lambda **kw: by_flow(scores.pool_vectors(df, "stream_id", "logits", C, **kw), "pooled")
    check(pool(mode="max"), flow, lambda m: logits[m].max(axis=0))
    check(pool(mode="mean", first_n=3, order_by="packet_id"), flow, lambda m: logits[m][:3].mean(axis=0))
    check(pool(mode="attn", score=F.col("w"), tau=2.0), flow,
          lambda m: (soft(weight[m] / 2.0)[:, None] * logits[m]).sum(axis=0))
    with pytest.raises(ValueError):
        pool(mode="attn")


def test_flow_label(data):
    df, flow, _, label, _ = data
    got = {r["stream_id"]: r for r in scores.flow_label(df).collect()}
    low = {r["stream_id"]: r["label_id"] for r in scores.flow_label(df, rule="smallest").collect()}
    for f in got:
        counts = np.bincount(label[flow == f], minlength=C)
        assert got[f]["label_id"] == counts.argmax()
        assert got[f]["is_mixed"] == ((counts > 0).sum() > 1)
        assert low[f] == label[flow == f].min()


def numpy_metrics(cm):
    tp = np.diag(cm).astype(float)
    p, r = tp / (cm.sum(axis=0) + 1e-8), tp / (cm.sum(axis=1) + 1e-8)
    f1 = 2 * p * r / (p + r + 1e-8)
    s = cm.sum(axis=1)
    return {
        "precision_macro": p.mean(), "recall_macro": r.mean(), "f1_macro": f1.mean(),
        "f1_weighted": (f1 * s).sum() / s.sum(), "accuracy": tp.sum() / cm.sum(),
    }


def test_metrics_count_empty_classes_and_skip_ids_out_of_range(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 0), (7, 0), (0, 9), (-1, 0)]
    df = spark.createDataFrame(pairs, "actual int, predicted int")
    cm = metrics.confusion_matrix(df, 4)
    assert cm.count() == 16
    matrix = np.zeros((4, 4), int)
    for a, p in pairs:
        if 0 <= a < 4 and 0 <= p < 4:
            matrix[a, p] += 1
    row = metrics.classification_metrics(cm).first()
    for name, value in numpy_metrics(matrix).items():
        assert row[name] == pytest.approx(value), name


def test_no_rows_give_zero_metrics(spark):
    row = metrics.classification_metrics(
        metrics.confusion_matrix(spark.createDataFrame([], "actual int, predicted int"), 3)
    ).first()
    assert row["accuracy"] == 0.0
    assert row["f1_weighted"] == 0.0


@pytest.mark.parametrize("use_prob", [True, False])
def test_flow_eval(data, use_prob):
    df, flow, logits, label, _ = data
    row = metrics.flow_eval(df, C, use_prob).first()
    cm = np.zeros((C, C), int)
    mixed = 0
    for f in np.unique(flow):
        m = flow == f
        counts = np.bincount(label[m], minlength=C)
        mixed += (counts > 0).sum() > 1
        cm[counts.argmax(), (soft(logits[m]) if use_prob else logits[m]).mean(axis=0).argmax()] += 1
    for name, value in numpy_metrics(cm).items():
        assert row[name] == pytest.approx(value), name
    assert (row["num_flows"], row["inconsistent_flows"]) == (len(np.unique(flow)), mixed)


def test_reject_eval(data):
    df, _, logits, label, _ = data
    best, pred = soft(logits).max(axis=1), logits.argmax(axis=1)
    keep = best >= 0.9
    cm = np.zeros((C, C), int)
    np.add.at(cm, (label[keep], pred[keep]), 1)
    row = metrics.reject_eval(df, C, 0.9).first()
    assert row["rejection_rate"] == pytest.approx(1 - keep.mean())
    for name, value in numpy_metrics(cm).items():
        assert row[f"accepted_{name}"] == pytest.approx(value), name
    nothing = metrics.reject_eval(df, C, 1.1).first()
    assert nothing["rejection_rate"] == 1.0
    assert nothing["accepted_accuracy"] == 0.0


def test_cm_percent_and_subset(spark):
    cm = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 0), (1, 1, 0)], "actual int, predicted int, n bigint")
    got = {(r["actual"], r["predicted"]): (r["percent"], r["row_place"]) for r in metrics.cm_percent(cm).collect()}
    assert got == {(0, 0): (25.0, 1), (0, 1): (75.0, 1), (1, 0): (0.0, 2), (1, 1): (0.0, 2)}
    rows = [("m1", a, p, 1) for a in "abc" for p in "abc"] + [("m2", a, p, 2) for a in "bcd" for p in "bcd"]
    cms = spark.createDataFrame(rows, "matrix_id string, actual string, predicted string, n bigint")
    got = {(r["matrix_id"], r["actual"], r["predicted"]): (r["row_place"], r["column_place"])
           for r in metrics.cm_subset(cms, ["c", "x", "a", "b"]).collect()}
    place = {"c": 0, "b": 1}
    assert got == {(m, a, p): (place[a], place[p]) for m in ("m1", "m2") for a in "bc" for p in "bc"}


def test_importance(spark):
    rows = [("a", "ip.len", 0.9), ("a", "x", 0.1), ("a", "root", 0.4), ("b", "y", 0.5), ("c", "ip.ttl", 0.3)]
    df = spark.createDataFrame(rows, "expert_name string, feature_name string, importance_score double")
    every = {(r["expert_name"], r["feature_name"]): r["ngi"] for r in importance.ngi(df).collect()}
    z = soft(np.array([r[2] for r in rows]) / 0.2)
    assert every == pytest.approx({r[:2]: v for r, v in zip(rows, z, strict=True)})
    assert sum(every.values()) == pytest.approx(1.0)
    g = {r["expert_name"]: r for r in importance.gcs_per_expert(df).collect()}
    p = soft(np.array([0.9, 0.1, 0.4]) / 0.2)
    assert g["a"]["gcs"] == pytest.approx(-(p * np.log(p + 1e-12)).sum())
    assert g["b"]["log_n_over_gcs"] is None
    valid = importance.ngi_valid_fields(df, ["ip.len", "ip.ttl"])
    assert {(r["expert_name"], r["feature_name"]) for r in valid.collect()} == {
        ("a", "ip.len"), ("a", "root"), ("c", "ip.ttl")
    }


def test_ngi_survives_large_scores(spark):
    df = spark.createDataFrame([("a", "f", 900.0), ("a", "g", 899.9), ("a", "h", -900.0)],
                               "expert_name string, feature_name string, importance_score double")
    got = {r["feature_name"]: r["ngi"] for r in importance.ngi(df, by=["expert_name"]).collect()}
    want = soft(np.array([900.0, 899.9, -900.0]) / 0.2)
    assert [got["f"], got["g"], got["h"]] == pytest.approx(list(want), abs=1e-9)

"""Sizes, membership and invariants of splits and samples."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import sampling


def order_of(key):
    return hashlib.md5(f"42|{key}".encode()).hexdigest()


def sizes(n, test=0.1, val=0.1):
    n_test = math.ceil(test * n)
    if n - n_test < 1:
        return 0, 0
    rest = n - n_test
    n_val = math.ceil(val / (1 - test) * rest)
    return n_test, (n_val if rest - n_val >= 1 else 0)


@pytest.fixture(scope="module")
def packets(spark):
    rng = random.Random(5)
    rows, frame = [], 0
    for label, n_flows in (("a", 60), ("b", 25), ("c", 2), ("d", 7), ("label", 3)):
        for flow in range(n_flows):
            for _ in range(rng.choice([1, 2, 3, 10, 40])):
                frame += 1
                rows.append((frame, label, f"{label}{flow}"))
    rows.append((frame + 1, "a", None))
    return rows, spark.createDataFrame(rows, "frame_num bigint, label string, stream_id string").repartition(5)


def test_split_packets(packets):
    rows, df = packets
    got = {r["frame_num"]: r["split"] for r in sampling.split_packets(df, "frame_num").collect()}
    by_label = defaultdict(list)
    for frame, label, _ in rows:
        if label != "label":
            by_label[label].append(frame)
    assert set(got) == {f for fs in by_label.values() for f in fs}
    for frames in by_label.values():
        n_test, n_val = sizes(len(frames))
        order = sorted(frames, key=order_of)
        assert {f for f in frames if got[f] == "test"} == set(order[:n_test])
        assert {f for f in frames if got[f] == "validation"} == set(order[n_test : n_test + n_val])


def test_split_flows_keeps_flows_whole(packets):
    rows, df = packets
    got = sampling.split_flows(df).toPandas()
    assert got.groupby(["label", "stream_id"])["split"].nunique().max() == 1
    assert set(got[got["label"] == "c"]["split"]) == {"train"}
    for label, n_flows in (("a", 60), ("b", 25), ("d", 7)):
        flows = got[got["label"] == label].drop_duplicates("stream_id")
        n_test, n_val = sizes(n_flows)
        assert Counter(flows["split"]) == Counter(
            {"test": n_test, "validation": n_val, "train": n_flows - n_test - n_val}
        )
    assert len(got) == sum(1 for _, label, flow in rows if label != "label" and flow is not None)


def apportion(counts, draws):
    """Largest remainder with ties to the lower bin."""
    whole = sum(counts)
    base = [draws * c // whole for c in counts]
    rest = [draws * c - b * whole for c, b in zip(counts, base, strict=True)]
    for i in sorted(range(len(counts)), key=lambda i: (-rest[i], i))[: draws - sum(base)]:
        base[i] += 1
    return base


def expected_length_split(flows):
    """flow -> split for one label, by trying fewer and fewer quantile bins."""
    ids = sorted(flows)
    n = len(ids)
    if n < 3:
        return dict.fromkeys(ids, "train")
    n_test, n_val = sizes(n)
    binned = None
    for k in range(min(4, n), 1, -1):
        bins = pd.qcut([flows[f] for f in ids], q=k, labels=False, duplicates="drop")
        counts = Counter(bins.tolist())
        if len(counts) >= 2 and min(counts.values()) >= 2 and n_test >= len(counts) and n - n_test >= len(counts):
            binned = dict(zip(ids, bins.tolist(), strict=True))
            break
    if binned is None:
        binned = dict.fromkeys(ids, 0)
    names = sorted(set(binned.values()))
    groups = [sorted((f for f in ids if binned[f] == b), key=order_of) for b in names]
    rest = apportion([len(g) for g in groups], n - n_test)
    ok = len(groups) == 1 or (min(rest) >= 2 and n_val >= len(groups) and n - n_test - n_val >= len(groups))
    kept = apportion(rest, n - n_test - n_val) if ok and n_val else rest
    out = {}
    for group, r, k in zip(groups, rest, kept, strict=True):
        t = len(group) - r
        for i, flow in enumerate(group):
            out[flow] = "test" if i < t else "validation" if i < t + r - k else "train"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_flows_by_length(spark, seed):
    rng = random.Random(seed)
    rows, want, frame = [], {}, 0
    for label, n_flows, choices in (
        ("many", 120, range(1, 40)), ("ties", 50, [1, 1, 1, 1, 9]), ("same", 30, [2]), ("few", 5, [1, 2, 3]),
        ("two", 2, [1, 4]),
    ):
        flows = {f"{label}{i}": rng.choice(list(choices)) for i in range(n_flows)}
        want.update(expected_length_split(flows))
        for flow, count in flows.items():
            for _ in range(count):
                frame += 1
                rows.append((frame, label, flow))
    df = spark.createDataFrame(rows, "frame_num bigint, label string, stream_id string")
    got = sampling.split_flows_by_length(df, "frame_num").toPandas()
    assert len(got) == len(rows)
    assert got.groupby("stream_id")["split"].first().to_dict() == want


@pytest.mark.parametrize(("ratio", "p"), [(0.7, 0.3), (0.1, 0.9), (1.0, 0.2), (0.5, 1.0)])
def test_sample_flows_prefers_long_flows(packets, ratio, p):
    rows, df = packets
    counts = defaultdict(Counter)
    for _, label, flow in rows:
        if flow is not None:
            counts[label][flow] += 1
    got = sampling.sample_flows(df, p, "frame_num", prefer_long=True, long_ratio=ratio).toPandas()
    for label, flows in counts.items():
        n = len(flows)
        target = min(max(round(n * p), 1), n)
        chosen = set(got[got["label"] == label]["stream_id"])
        assert len(chosen) == target
        ranked = sorted(flows, key=lambda f: (-flows[f], order_of(f)))
        pool = set(ranked[: max(1, math.ceil(n * 0.5))])
        assert len(chosen & pool) >= min(math.ceil(target * ratio), target, len(pool))
    kept = got.groupby("stream_id").size().to_dict()
    assert all(kept[f] == counts[f.rstrip("0123456789")][f] for f in kept)


def test_sample_flows_plain(packets):
    rows, df = packets
    got = sampling.sample_flows(df, 0.5, "frame_num").toPandas()
    flows = defaultdict(set)
    for _, label, flow in rows:
        if flow:
            flows[label].add(flow)
    for label, ids in flows.items():
        want = sorted(ids, key=order_of)[: min(max(round(len(ids) * 0.5), 1), len(ids))]
        assert set(got[got["label"] == label]["stream_id"]) == set(want)
    with pytest.raises(ValueError):
        sampling.sample_flows(df, 0.0, "frame_num")


@pytest.fixture(scope="module")
def unbalanced(spark):
    rows = [(i, "hot" if i % 3 else "mid" if i % 2 else "rare" if i % 60 == 0 else "low") for i in range(900)]
    return Counter(r[1] for r in rows), spark.createDataFrame(rows, "id bigint, label string")


@pytest.mark.parametrize("p", [0.01, 0.1, 0.35])
def test_sample_sizes(unbalanced, p):
    counts, df = unbalanced
    average = round(p * sum(counts.values()) / len(counts))

    def got(frame):
        return {r["label"]: r["count"] for r in frame.groupBy("label").count().collect()}

    assert got(sampling.sample_proportional(df, p, "id")) == {k: max(round(n * p), 1) for k, n in counts.items()}
    assert got(sampling.sample_hybrid(df, p, "id")) == {
        k: n if n <= average else max(round(n * p), average) for k, n in counts.items()
    }
    assert got(sampling.sample_capped(df, p, "id")) == {k: min(n, average) for k, n in counts.items()}


@pytest.mark.parametrize("p", [0.05, 0.5, 1.0])
def test_balance(unbalanced, p):
    counts, df = unbalanced
    average = max(round(p * sum(counts.values()) / len(counts)), 1)
    got = sampling.balance(df, p, "id").toPandas()
    assert got.groupby("label").size().to_dict() == dict.fromkeys(counts, average)
    for label, n in counts.items():
        copies = got[got["label"] == label].groupby("id").size()
        assert copies.max() - (copies.min() if len(copies) == n else 0) <= 1
    assert not got.duplicated(["id", "copy"]).any()


def test_edge_proportions(unbalanced):
    counts, df = unbalanced
    assert sampling.sample_proportional(df, 0.0, "id").count() == 0
    assert sampling.sample_proportional(df, 1.0, "id").count() == sum(counts.values())
    for call in (sampling.sample_hybrid, sampling.sample_capped, sampling.balance):
        with pytest.raises(ValueError):
            call(df, 0.0, "id")


def test_split_is_reproducible(packets):
    _, df = packets
    first = sampling.split_flows(df).groupBy("split").agg(F.bit_xor("frame_num").alias("x")).collect()
    again = sampling.split_flows(df.repartition(11)).groupBy("split").agg(F.bit_xor("frame_num").alias("x")).collect()
    assert sorted(first) == sorted(again)
    assert np.all([r["split"] for r in first])


def test_balance_spreads_many_copies_of_one_row(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") == 0, "rare").otherwise("common").alias("label"))
    got = sampling.balance(df, 1.0, "id").filter("label = 'rare'")
    parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 100_000 and len(parts) > 1
    assert got.select("copy").distinct().count() == 100_000

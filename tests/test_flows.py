"""Flow statistics and packet-level flow features against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows


def make_packets(seed=3, n=1200, step=700):
    """A hot flow, single-packet flows, equal times, long pauses and unreadable ids."""
    rng = np.random.default_rng(seed)
    flow = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n)).astype(object)
    flow[5], flow[6] = None, "junk"
    time = np.round(np.cumsum(rng.choice([0, 0, 1, step, 5 * step], n)), 3)
    order = rng.permutation(n)
    pdf = pd.DataFrame(
        {
            "frame_num": np.arange(n),
            "stream_id": [None if f is None else str(f) for f in flow],
            "ip.len": [format(int(x), "x") for x in rng.integers(40, 1600, n)],
            "frame.time_epoch": [str(t) for t in time[order]],
            "ip.src": np.where(rng.random(n) < 0.5, "0a000001", "0a000002"),
            "ip.dst": np.where(rng.random(n) < 0.5, "0a000002", "0a000001"),
        }
    )
    pdf.loc[::17, "ip.src"] = None
    pdf.loc[7, "frame.time_epoch"] = "bad"
    return pdf


def expected_stats(pdf):
    work = pd.DataFrame(
        {
            "flow": pd.to_numeric(pdf["stream_id"], errors="coerce").fillna(-1).astype("int64"),
            "len": [int(x, 16) for x in pdf["ip.len"]],
            "t": pd.to_numeric(pdf["frame.time_epoch"], errors="coerce").fillna(0.0),
        }
    )
    by = work.groupby("flow")
    out = pd.DataFrame(
        {
            "flow_avg_len": by["len"].mean(),
            "flow_std_len": by["len"].std().fillna(0),
            "flow_pkt_count": by["len"].count(),
        }
    )
    big = work[work["len"] > 1400].groupby("flow").size().reindex(out.index, fill_value=0)
    out["flow_large_pkt_ratio"] = big / (out["flow_pkt_count"] + 1e-6)
    work = work.sort_values(["flow", "t"])
    work["gap"] = work.groupby("flow")["t"].diff().fillna(0)
    gaps = work.groupby("flow")
    out["flow_avg_iat"] = gaps["gap"].mean()
    out["flow_std_iat"] = gaps["gap"].std().fillna(0)
    out["flow_max_iat"] = gaps["gap"].max()
    out["flow_duration_per_pkt"] = (gaps["t"].max() - gaps["t"].min()) / (out["flow_pkt_count"] + 1e-6)
    return out


@pytest.mark.parametrize(("chunks", "hot_rows", "step"), [(2, 1, 700), (8, 20, 700), (256, 20, 0.001), (256, 200, 700), (256, 1, 700), (4, 10**6, 700)])
def test_flow_stats_do_not_depend_on_chunks(spark, monkeypatch, chunks, hot_rows, step):
    monkeypatch.setattr(flows, "CHUNKS", chunks)
    pdf = make_packets(step=step)
    got = flows.flow_stats(spark.createDataFrame(pdf), hot_rows=hot_rows).toPandas().set_index("flow").sort_index()
    want = expected_stats(pdf).sort_index()
    assert got.index.is_unique
    assert list(got.index) == list(want.index)
    for name in want.columns:
        np.testing.assert_allclose(got[name].astype(float), want[name], rtol=1e-9, atol=1e-9, err_msg=name)


def test_flow_stats_without_time_or_length(spark):
    df = spark.createDataFrame(make_packets()).drop("frame.time_epoch")
    assert set(flows.flow_stats(df).columns) == {"flow", *flows.LENGTH_FEATURES}
    with pytest.raises(KeyError):
        flows.flow_stats(df.drop("ip.len"))


def test_timestamp_option_wins_and_missing_is_zero(spark):
    rows = [(1, "1", "28", "080a0000000a00000000", "99"), (2, "1", "28", None, "98"),
            (3, "1", "28", "080a0000001400000000", "97")]
    df = spark.createDataFrame(rows, "frame_num int, stream_id string, `ip.len` string, "
                               "`tcp.options.timestamp` string, `frame.time_epoch` string")
    row = flows.flow_stats(df).first()
    assert row["flow_max_iat"] == 10.0
    assert row["flow_avg_iat"] == pytest.approx(20 / 3)


@pytest.mark.parametrize(("chunks", "hot_rows", "step"), [(256, 10**6, 700), (2, 50, 700), (256, 50, 0.001), (256, 1, 700)])
def test_direction_and_gap(spark, monkeypatch, chunks, hot_rows, step):
    monkeypatch.setattr(flows, "CHUNKS", chunks)
    pdf = make_packets(step=step)
    got = flows.direction_and_gap(spark.createDataFrame(pdf), "frame_num", hot_rows=hot_rows).toPandas().sort_values("frame_num")
    work = pdf.assign(
        flow=pd.to_numeric(pdf["stream_id"], errors="coerce").fillna(-1),
        t=pd.to_numeric(pdf["frame.time_epoch"], errors="coerce").fillna(0.0),
    ).sort_values(["flow", "t"], kind="mergesort")
    by = work.groupby("flow", sort=False)
    first_src, first_dst = by["ip.src"].transform("first").fillna(""), by["ip.dst"].transform("first").fillna("")
    same = (work["ip.src"].fillna("") == first_src) & (work["ip.dst"].fillna("") == first_dst)
    work["sign"] = np.where(same, 1.0, -1.0)
    work["gap"] = by["t"].diff().fillna(0)
    work = work.sort_values("frame_num")
    assert list(got["flow_dir_sign"]) == list(work["sign"])
    np.testing.assert_allclose(got["flow_iat_local"], work["gap"])


def test_direction_falls_back_to_ports_then_zero(spark):
    rows = [(1, "1", "a", "b"), (2, "1", "b", "a"), (3, "1", "a", "b")]
    df = spark.createDataFrame(rows, "frame_num bigint, stream_id string, `tcp.srcport` string, `tcp.dstport` string")
    got = {r["frame_num"]: r["flow_dir_sign"] for r in flows.direction_and_gap(df, "frame_num").collect()}
    assert got == {1: 1.0, 2: -1.0, 3: 1.0}
    bare = flows.direction_and_gap(df.select("frame_num", "stream_id"), "frame_num").collect()
    assert {(r["flow_dir_sign"], r["flow_iat_local"]) for r in bare} == {(0.0, 0.0)}


def test_stream_key_ignores_direction_and_needs_its_columns(spark):
    rows = [("0xC0A80001", "c0a80002", "1bb", "c000", "06"), ("c0a80002", "c0a80001", "c000", "0x1BB", "06"),
            (None, "c0a80001", "c000", "1bb", "06")]
    df = spark.createDataFrame(
        rows, "`ip.src` string, `ip.dst` string, `tcp.srcport` string, `tcp.dstport` string, `ip.proto` string"
    )
    keys = [r[0] for r in df.select(flows.stream_key(df)).collect()]
    assert keys[0] == keys[1] == "06|c0a80001:1bb|c0a80002:c000"
    assert keys[2] == "06|0:c000|c0a80001:1bb"
    with pytest.raises(KeyError):
        flows.stream_key(df.drop("ip.proto"))


def test_reassembly_follows_frame_order(spark):
    rows = [(1, None), (2, "#1 #2"), (3, "#2 #3 #5"), (4, "#9"), (5, None)]
    df = spark.createDataFrame(rows, "f bigint, text string")
    got = {r["frame_num"]: r["reassembled"] for r in flows.reassembly(df, "f", F.col("text")).collect()}
    assert got == {1: [1, 2], 2: [2, 3, 5], 3: [2, 3, 5], 4: [], 5: [], 9: [9]}


def test_caps_and_batches(spark):
    pdf = make_packets()
    df = spark.createDataFrame(pdf).fillna("x", ["stream_id"])
    sizes = pdf["stream_id"].fillna("x").value_counts()
    capped = flows.cap_packets(df, 7, 42, "frame_num").groupBy("stream_id").count().collect()
    assert {r["stream_id"]: r["count"] for r in capped} == {k: min(v, 7) for k, v in sizes.items()}
    assert flows.cap_packets(df, None, 42, "frame_num") is df
    batches = flows.flow_batches(df, 3, 4, "frame_num").toPandas()
    order = list(dict.fromkeys(pdf["stream_id"].fillna("x")))
    want = {flow: i // 4 for i, flow in enumerate(order)}
    assert {f: set(g["batch_id"]) for f, g in batches.groupby("stream_id")} == {f: {b} for f, b in want.items()}
    whole = flows.flow_batches(df, 3, 4, "frame_num", drop_last=True).agg(F.max("batch_id")).first()[0]
    assert whole == len(order) // 4 - 1


def test_flow_feature_defaults(spark):
    rows = [(1, "1", "64", "train"), (2, "1", "c8", "train"), (3, "2", "12c", "train"), (4, "9", "64", "test")]
    df = spark.createDataFrame(rows, "frame_num bigint, stream_id string, `ip.len` string, split string")
    got = {r["frame_num"]: r for r in flows.flow_features(df, "open_world", "frame_num").collect()}
    assert got[1]["flow_avg_len"] == 150.0
    assert got[4]["flow_avg_len"] == 225.0
    assert got[4]["flow_pkt_count"] == 1.0
    own = {r["frame_num"]: r for r in flows.flow_features(df, "per_split", "frame_num").collect()}
    assert own[4]["flow_avg_len"] == 100.0
    with pytest.raises(ValueError):
        flows.flow_features(df, "nothing", "frame_num")


def test_features_come_from_the_uncapped_packets(spark):
    rows = [(i, "1", "64" if i < 5 else "c8", "train") for i in range(10)]
    df = spark.createDataFrame(rows, "frame_num bigint, stream_id string, `ip.len` string, split string")
    capped = flows.cap_packets(df, 2, 42, "frame_num")
    got = flows.flow_features(capped, "per_split", "frame_num", full=df).collect()
    assert len(got) == 2
    assert {r["flow_pkt_count"] for r in got} == {10.0}
    assert {r["flow_avg_len"] for r in got} == {150.0}


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_direction_stays_inside_a_split(spark, hot_rows):
    rows = [(1, "7", "train", "0a", "0b", "1.0"), (2, "7", "test", "0b", "0a", "5.0"), (3, "7", "test", "0a", "0b", "6.0")]
    df = spark.createDataFrame(rows, "frame_num int, stream_id string, split string, `ip.src` string, `ip.dst` string, `frame.time_epoch` string")
    out = flows.direction_and_gap(df, "frame_num", hot_rows=hot_rows, keys=["split"]).orderBy("frame_num").collect()
    assert [(r.flow_dir_sign, r.flow_iat_local) for r in out] == [(1.0, 0.0), (1.0, 0.0), (-1.0, 1.0)]


def test_a_burst_is_cut_into_chunks(spark):
    # all packets of the flow inside one second
    rows = [("7", "64", f"{1000 + (i * i % 997) / 1000:.3f}") for i in range(2000)]
    df = spark.createDataFrame(rows, "stream_id string, `ip.len` string, `frame.time_epoch` string")
    times = df.select(F.lit(7).alias("flow"), F.col("`frame.time_epoch`").cast("double").alias("t")).distinct()
    sizes = flows.quantile_chunks(times, ["flow"], 50).groupBy("_chunk").agg(F.count("t").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    found = sorted((r["_chunk"], r["n"], r["a"], r["b"]) for r in sizes.collect())
    assert len(found) >= 8 and max(n for _, n, _, _ in found) <= 50
    assert all(one[3] < other[2] for one, other in zip(found, found[1:]))
    hot, whole = (flows.flow_stats(df, hot_rows=n).first().asDict() for n in (50, 10**6))
    assert hot == pytest.approx(whole)


def test_packets_are_scanned_once(spark, tmp_path):
    spark.createDataFrame(make_packets()).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = flows.flow_stats(df)._jdf.queryExecution().executedPlan().toString()
    # what is left reads the stored table, with a single shuffle for the window and the aggregate
    assert str(tmp_path) not in plan and plan.count("Exchange") == 1 and plan.count("FileScan") == 1
    context = flows.direction_and_gap(df, "frame_num")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in context


def test_keys_are_scanned_once_for_ranks_and_hot_flows(spark, tmp_path):
    spark.createDataFrame(make_packets()).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).withColumns({n: F.lit("1") for n in ("tcp.srcport", "tcp.dstport", "ip.proto")})
    plan = flows.add_stream_id(df, "frame_num")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1

"""Vocabularies, label maps, weights, encoded packets."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.catalog import CATALOG, fields_of_type
from flowloom.operators import encode


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, "b", "0x06", "C0A80001", "1bb", "28", "5", "080a0000000a00000000"),
        (2, "a", "11", None, "c000", "5dc", "x", None),
        (3, "b", None, "0", "0x1BB", "zz", None, "bad"),
        (4, "c", "06", "c0a80002", None, None, "7.0", "080a0000001400000000"),
    ]
    return spark.createDataFrame(
        rows,
        "frame_num bigint, label string, `ip.proto` string, `ip.src` string, `tcp.srcport` string, `ip.len` string, "
        "`tcp.stream` string, `tcp.options.timestamp` string",
    )


def test_catalog():
    assert len(CATALOG) == 101
    assert Counter(CATALOG.values()) == {"categorical": 52, "numerical": 45, "address_ipv4": 2, "address_mac": 2}
    assert fields_of_type("address_mac") == ["eth.dst", "eth.src"]


def test_vocab_variants(df):
    v1 = {(r["field"], r["value"]): r["id"] for r in encode.build_vocab(df, ["ip.proto", "absent"], "v1").collect()}
    assert v1 == {("ip.proto", "06"): 0, ("ip.proto", "11"): 1, ("ip.proto", "__OOV__"): 2}
    v2 = {(r["field"], r["value"]): r["id"] for r in encode.build_vocab(df, ["ip.proto"], "v2").collect()}
    assert v2 == {("ip.proto", "06"): 1, ("ip.proto", "11"): 2, ("ip.proto", "__OOV__"): 0}


@pytest.mark.parametrize("max_rows", [1, 100])
def test_encode_categorical_small_and_large_vocabularies(df, max_rows):
    vocab = encode.build_vocab(df.filter(F.col("frame_num") != 2), ["ip.proto"], "v1")
    lookup = encode.Vocabulary(vocab, max_rows)
    assert (lookup.small, lookup.large) == ((["ip.proto"], []) if max_rows == 100 else ([], ["ip.proto"]))
    got = {r["frame_num"]: r["code"] for r in lookup.encode(df, {"ip.proto": "code"}, "frame_num").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_large_fields_share_one_lookup(spark):
    names = [f"f{i}.x" for i in range(6)]
    rows = [(i, *[None if (i + k) % 11 == 0 else format(i * (k + 3) % 40 if i % 3 else 0, "x") for k in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "n bigint, " + ", ".join(f"`{n}` string" for n in names)).repartition(5)
    vocab = encode.build_vocab(df.filter("n < 350"), names)
    least = min(r["count"] for r in vocab.groupBy("field").count().collect())
    outputs = {n: n for n in names}
    whole, split = encode.Vocabulary(vocab, 10**6), encode.Vocabulary(vocab, least)
    assert len(whole.small) == 6 and len(split.large) == 5
    one, other = (v.encode(df, outputs, "n") for v in (whole, split))
    assert one.columns == other.columns == ["n", *names]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    # one join back to the rows besides the broadcast of the small field, however many fields are large
    plan = other._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("Join Inner") <= 1


def test_encode_packets(df):
    vocab = encode.build_vocab(df, ["ip.proto"])
    got = {r["frame_num"]: r for r in
           encode.encode_packets(df.withColumn("flow_x", F.lit("bad")), CATALOG, vocab, "frame_num").collect()}
    assert got[1]["ip.src"] == [192, 168, 0, 1]
    assert got[3]["ip.src"] == [0, 0, 0, 0]
    assert [got[i]["tcp.srcport"] for i in (1, 2, 3, 4)] == [1, 3, 1, 0]
    assert got[1]["ip.len"] == pytest.approx(math.log1p(40))
    assert got[3]["ip.len"] == 0.0
    assert [got[i]["tcp.stream"] for i in (1, 2, 3, 4)] == [5, 0, 0, 7]
    assert got[4]["tcp.options.timestamp"] == pytest.approx(math.log1p(20))
    assert [got[i]["ip.proto"] for i in (1, 2, 3, 4)] == [1, 2, 0, 1]
    assert got[2]["flow_x"] == 0.0


def test_label_map_and_unseen(df):
    labels = encode.label_map(df.filter(F.col("frame_num") < 3), "frame_num")
    assert {r["label"]: r["label_id"] for r in labels.collect()} == {"b": 0, "a": 1}
    got = {r["frame_num"]: r["label_id"] for r in encode.apply_label_map(df, labels).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: -1}


def test_integer_code(spark):
    rows = [(1, "[1, 2]"), (2, "[]"), (3, None), (4, "[3]"), (5, "[1, 2]"), (6, None)]
    df = spark.createDataFrame(rows, "n bigint, s string")
    got = {r["n"]: r["code"] for r in encode.integer_code(df, "s", "n").collect()}
    assert got == {1: 0, 2: -1, 3: 1, 4: 2, 5: 0, 6: 1}


@pytest.mark.parametrize("smoothing", ["none", "sqrt", "log"])
def test_class_weights(spark, smoothing):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "label_id int")
    got = [r["weight"] for r in encode.class_weights(df, 3, smoothing=smoothing, clamp=(0.5, 5.0)).orderBy(
        "label_id").collect()]
    raw = [101 / (3 * n) for n in (90, 10, 1)]
    shape = {"none": lambda x: x, "sqrt": math.sqrt, "log": math.log1p}[smoothing]
    assert got == pytest.approx([min(max(shape(x), 0.5), 5.0) for x in raw])
    with pytest.raises(ValueError):
        encode.class_weights(df, 3, smoothing="other")


def test_perturb_is_reproducible_and_bounded(df):
    def noisy(**kw):
        return {r["frame_num"]: r for r in encode.perturb(df, "frame_num", **kw).collect()}

    plain = noisy()
    assert plain[1]["ip_len_encoded"] == pytest.approx(math.log1p(40))
    one, two = noisy(len_noise=0.5, iat_noise=1e6), noisy(len_noise=0.5, iat_noise=1e6)
    assert one == two
    for row in one.values():
        assert row["timestamp_encoded"] >= 0
        assert row["ip_len_encoded"] <= math.log1p(1500 * 1.5)
    assert noisy(len_noise=0.5, seed=1)[2]["ip_len_encoded"] != one[2]["ip_len_encoded"]


def test_expert_columns(spark):
    fields = ["eth.src", "eth.type", "ip.src", "tcp.srcport", "tcp.options.mss", "tcp.option_kind", "tls.record.version",
              "tls.x509if.oid", "tls.alert_message.level"]
    df = spark.createDataFrame([(f,) for f in fields], "field string")
    got = {r["field"]: r["expert"] for r in encode.expert_columns(df).collect()}
    assert got == {
        "eth.src": "eth", "eth.type": "eth", "ip.src": "ip", "tcp.srcport": "tcp_core", "tcp.options.mss": "tcp_options",
        "tcp.option_kind": "tcp_core", "tls.record.version": "tls_record", "tls.x509if.oid": "tls_x509",
    }
    few = encode.expert_columns(df, ["eth", "tcp"], use_mac=False, use_port=False)
    assert {r["field"] for r in few.collect()} == {"eth.type", "tcp.options.mss", "tcp.option_kind"}


def test_field_without_values_keeps_its_column(df):
    empty = df.withColumn("tls.handshake.type", F.lit(None).cast("string"))
    vocab = encode.build_vocab(empty, ["ip.proto", "tls.handshake.type"])
    assert [tuple(r) for r in vocab.filter("field = 'tls.handshake.type'").collect()] == [("tls.handshake.type", encode.OOV, 0)]
    for known in (vocab, encode.build_vocab(empty, ["ip.proto"])):
        coded = encode.encode_packets(empty, CATALOG, known, "frame_num")
        assert {r[0] for r in coded.select("`tls.handshake.type`").collect()} == {0}


def test_vocab_of_values_with_a_common_beginning(spark):
    values = [f"www.{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "`tls.handshake.extensions_server_name` string").repartition(7)
    got = encode.build_vocab(df, df.columns).filter(F.col("value") != encode.OOV)
    assert {r["value"]: r["id"] for r in got.collect()} == {v: i + 1 for i, v in enumerate(values)}

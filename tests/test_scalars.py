"""Scalar expressions on the texts that break naive conversions."""

import math

import pytest
from pyspark.sql import functions as F

from flowloom.functions import scalars


def evaluate(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        (None, 0), ("", 0), ("1f", 31), ("0x1F", 31), ("1g", 0), ("xyz", 0), ("1f.0", 31), ("0", 0), ("0000", 0),
        ("ffffffffffffffff", 2**63 - 1), ("7fffffffffffffff", 2**63 - 1), ("8000000000000000", 2**63 - 1),
        ("1" + "0" * 30, 2**63 - 1), ("0" * 40 + "a", 10), (".5", 0), ("0x", 0),
    ],
)
def test_hex_to_long(spark, text, number):
    assert evaluate(spark, scalars.hex_to_long, text) == number


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("080a" + "0000000f" + "00000001", 15), ("0x080A0000000F00000001", 15), (None, 0), ("080a0000", 0),
        ("090a0000000f00000001", 0), ("080azzzzzzzz00000001", 0),
    ],
)
def test_tsval(spark, text, number):
    assert evaluate(spark, scalars.tsval, text) == number


@pytest.mark.parametrize(
    ("text", "kind", "expected"),
    [
        ("c0a80503", "ipv4", [192, 168, 5, 3]), ("0xC0A80503", "ipv4", [192, 168, 5, 3]), ("0", "ipv4", [0] * 4),
        (None, "ipv4", [0] * 4), ("zza80503", "ipv4", [0] * 4), ("c0a80503zz", "ipv4", [192, 168, 5, 3]),
        ("f42d06784ee9", "mac", [244, 45, 6, 120, 78, 233]), ("f42d06784e", "mac", [0] * 6), ("", "mac", [0] * 6),
    ],
)
def test_octets(spark, text, kind, expected):
    assert evaluate(spark, lambda v: scalars.octets(v, kind), text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("0", 0), ("1", 1), ("3ff", 1), ("400", 2), ("bfff", 2), ("c000", 3), (None, 0), ("bad!", 0)],
)
def test_port_bin(spark, text, expected):
    assert evaluate(spark, scalars.port_bin, text) == expected


@pytest.mark.parametrize(
    ("size", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (3712, "3.62 KB"), (5 * 1024**3, "5.00 GB")]
)
def test_format_bytes(spark, size, text):
    assert evaluate(spark, scalars.format_bytes, size, "bigint") == text


def test_strip_prefix_and_segments(spark):
    assert evaluate(spark, lambda v: scalars.strip_prefix(v, "tcp."), "tcp.Options.mss-val") == "options_mss_val"
    assert evaluate(spark, lambda v: scalars.strip_prefix(v, "tcp.", False), "tcp.Options.mss") == "Options.mss"
    assert evaluate(spark, scalars.segment_numbers, "#12(10), x 7 #3") == [12, 3]
    assert evaluate(spark, scalars.segment_numbers, "none") == []


def test_softmax_is_stable_and_argmax_takes_the_first(spark):
    row = spark.createDataFrame([([1000.0, 1000.0, -1000.0],)], "x array<double>").select(
        scalars.softmax(F.col("x")).alias("p"),
        scalars.argmax(F.col("x")).alias("a"),
        scalars.max_probability(F.col("x")).alias("m"),
        scalars.logsumexp(F.col("x")).alias("l"),
    ).first()
    assert row["p"] == pytest.approx([0.5, 0.5, 0.0])
    assert row["a"] == 0
    assert row["m"] == pytest.approx(0.5)
    assert row["l"] == pytest.approx(1000 + math.log(2))


def test_focal_loss(spark):
    logits, alpha = [0.5, 2.0, -1.0], [1.0, 0.25, 3.0]
    ce = math.log(sum(math.exp(x) for x in logits)) - logits[1]
    expected = 0.25 * (1 - math.exp(-ce)) ** 2 * ce
    row = spark.createDataFrame([(logits, 1)], "x array<double>, y int").select(
        scalars.focal_loss(F.col("x"), F.col("y"), alpha, 2.0).alias("l")
    ).first()
    assert row["l"] == pytest.approx(expected)


def test_jaccard(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    got = row.select(
        scalars.jaccard(F.col("a"), F.col("b")).alias("x"), scalars.jaccard(F.col("e"), F.col("e")).alias("y")
    ).first()
    assert got["x"] == pytest.approx(1 / 3)
    assert got["y"] == 0.0

"""The skew-safe building blocks against brute force, with thresholds low enough to take every path."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowloom import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    rng = random.Random(1)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 40), rng.random() * 10 ** rng.randrange(0, 6))
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, x double").repartition(7)


def test_rank_by_number(spark, skewed):
    rows, df = skewed
    got = {r["id"]: r["rank"] for r in scale.rank_by_number(df, "id").collect()}
    assert got == {row[0]: i + 1 for i, row in enumerate(sorted(rows))}


def test_sorted_rank_within_groups(spark, skewed):
    rows, df = skewed
    ranked = scale.sorted_rank(df, [F.col("x"), F.col("id")], F.floor("x"), ["k"], "r")
    expected = {}
    for key in {r[1] for r in rows}:
        members = sorted((r[2], r[0]) for r in rows if r[1] == key)
        expected.update({rid: i + 1 for i, (_, rid) in enumerate(members)})
    assert {r["id"]: r["r"] for r in ranked.collect()} == expected


def test_hot_keys_are_bounded_and_found(spark, skewed):
    _, df = skewed
    assert [r["k"] for r in scale.hot_keys(df, ["k"], hot_rows=500).collect()] == [0]
    counted = df.groupBy("k").count()
    assert [r["k"] for r in scale.hot_keys(counted, ["k"], hot_rows=500, counts="count").collect()] == [0]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_skew_join_equals_plain_join(spark, skewed, how, hot_rows):
    _, df = skewed
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30)], "k bigint, v string")
    got = scale.skew_join(df, right, ["k"], how, salt_by=F.col("id"), hot_rows=hot_rows, salts=8)
    want = df.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())


def test_skew_join_spreads_the_hot_key(spark, skewed):
    _, df = skewed
    right = spark.createDataFrame([(0, "v")], "k bigint, v string")
    joined = scale.skew_join(df, right, ["k"], salt_by=F.col("id"), hot_rows=500, salts=8)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan


@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_top_per_group(spark, skewed, hot_rows):
    rows, df = skewed
    top = scale.top_per_group(df, ["k"], [F.desc("x")], 5, F.col("id"), hot_rows, 8)
    assert top.columns == df.columns
    got = {(r["k"], r["id"]) for r in top.collect()}
    expected = set()
    for key in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == key), key=lambda r: -r[2])[:5]
        expected |= {(key, r[0]) for r in best}
    assert got == expected


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_cuts_pick_the_first_rows_in_digest_order(spark, skewed, digits):
    rows, df = skewed
    hashed = scale.digest(42, F.col("id"))

    def quota(sizes):
        return sizes.withColumn("a", F.floor(F.col("n") * 0.1).cast("long")).withColumn("b", F.col("n") + 5)

    cuts = scale.hash_cuts(df, ["k"], hashed, quota, ["a", "b"], digits)
    got = df.join(cuts, "k").select("id", "k", scale.within_cut(hashed, "a").alias("a"),
                                    scale.within_cut(hashed, "b").alias("b")).collect()
    expected = set()
    for key in {r[1] for r in rows}:
        order = sorted((hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[1] == key)
        expected |= {rid for _, rid in order[: int(len(order) * 0.1)]}
    assert {r["id"] for r in got if r["a"]} == expected
    assert all(r["b"] for r in got)


def test_exact_medians(spark, skewed):
    rows, df = skewed
    got = {(r["k"], r["feature"]): r["median"] for r in scale.exact_medians(df, ["x", "id"], ["k"]).collect()}
    for key in {r[1] for r in rows}:
        assert got[key, "x"] == pytest.approx(statistics.median(r[2] for r in rows if r[1] == key))
        assert got[key, "id"] == pytest.approx(statistics.median(r[0] for r in rows if r[1] == key))
    ties = spark.createDataFrame([(0.0,)] * 50 + [(-3.0,)] * 49 + [(None,)], "x double")
    assert scale.exact_medians(ties, ["x"]).first()["median"] == 0.0


def test_small_side_checks_the_size(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert scale.small_rows(df, 100) is not None
    assert scale.small_rows(df, 99) is None
    large = scale.small_side(df, 10)
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert sorted(large.collect()) == sorted(df.collect())


def test_tiny_values_spread_over_buckets(spark):
    values = spark.range(1, 4001).select((F.col("id") * 2.5e-7).alias("x"))
    counts = values.groupBy(scale.magnitude_bucket(F.col("x")).alias("b")).count().agg(F.max("count")).first()[0]
    assert counts < 40
    signed = spark.createDataFrame([(x,) for x in (-3.0, -1e-9, 0.0, 1e-12, 5e-4, 2.0)], "x double")
    buckets = [r[0] for r in signed.orderBy("x").select(scale.magnitude_bucket(F.col("x"))).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) == 6
    assert scale.exact_medians(values, ["x"]).first()["median"] == pytest.approx(2000.5 * 2.5e-7)


def test_ranges_are_even_despite_an_outlier(spark):
    df = spark.range(10_000).select(F.when(F.col("id") == 0, -(10**15)).otherwise(10**12 + F.col("id")).alias("x"))
    sizes = [r["count"] for r in scale.with_ranges(df, "x", "range", 100).groupBy("range").count().collect()]
    assert max(sizes) <= 300
    assert scale.rank_by_number(df, "x").filter(F.col("rank") == 1).first()["x"] == -(10**15)
    assert scale.rank_by_number(df.limit(0), "x").count() == 0


def test_parts_of_a_hot_key_follow_its_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(0, "v")], "k bigint, v string")
    joined = scale.skew_join(df, right, ["k"], salt_by=F.col("id"), hot_rows=100)
    assert joined.filter("v = 'v'").count() == 2000 and joined.count() == 3000
    sizes = scale.hot_keys(df, ["k"], 100).collect()
    assert [(r["k"], r["_n"]) for r in sizes] == [(0, 2000)]

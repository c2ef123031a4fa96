"""Splits and samples with exact sizes.

Membership follows the md5 order of `seed|key`. Because a cut of that order is a digest threshold per group, packets
are classified by a filter: they are neither sorted nor shuffled by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.columns import drop_repeated_headers, valid_flow_rows
from flowloom.scale import c, digest, hash_cuts, skew_join, small_side, within_cut
from flowloom.session import durable

SEED = 42
#: Copies of a row that are made in one place.
COPIES = 4096


def share_sizes(n: Column, test: float, validation: float) -> tuple[Column, Column]:
    """Test and validation counts for n items: the share is rounded up, validation taken from the rest.

    Nothing is taken where too few items would remain to train on.
    """
    n_test = F.ceil(F.lit(float(test)) * n).cast("long")
    n_test = F.when(n - n_test >= 1, n_test).otherwise(F.lit(0).cast("long"))
    rest = n - n_test
    n_val = F.ceil(F.lit(validation / (1.0 - test)) * rest).cast("long")
    n_val = F.when((n_test > 0) & (rest - n_val >= 1), n_val).otherwise(F.lit(0).cast("long"))
    return n_test, n_val


def _split_quota(test: float, validation: float, fewest: int):
    def quota(sizes: DataFrame) -> DataFrame:
        n_test, n_val = share_sizes(F.col("n"), test, validation)
        enough = F.col("n") >= fewest
        none = F.lit(0).cast("long")
        return sizes.withColumn("_test", F.when(enough, n_test).otherwise(none)).withColumn(
            "_validation", F.col("_test") + F.when(enough, n_val).otherwise(none)
        )

    return quota


def _with_split(df: DataFrame, cuts: DataFrame, group: list[str], hashed: Column) -> DataFrame:
    keep = ["_test_upto", "_validation_upto"]
    named = df.join(cuts.select(*group, *keep), group, "left").withColumn("_h", hashed)
    split = (
        F.when(within_cut(F.col("_h"), "_test"), F.lit("test"))
        .when(within_cut(F.col("_h"), "_validation"), F.lit("validation"))
        .otherwise(F.lit("train"))
    )
    return named.withColumn("split", split).drop("_h", *keep)


def split_packets(
    df: DataFrame, key: str, label: str = "label", test: float = 0.1, validation: float = 0.1, seed: int = SEED
) -> DataFrame:
    """Add `split`, stratified by label over single packets with a unique `key`."""
    clean = drop_repeated_headers(df, label)
    hashed = digest(seed, c(key))
    cuts = hash_cuts(clean, [label], hashed, _split_quota(test, validation, 2), ["_test", "_validation"])
    return _with_split(clean, cuts, [label], hashed)


def split_flows(
    df: DataFrame,
    flow: str = "stream_id",
    label: str = "label",
    test: float = 0.1,
    validation: float = 0.1,
    seed: int = SEED,
) -> DataFrame:
    """Add `split` by whole flows inside each label; a label with fewer than 3 flows only trains.

    A flow is identified by (label, flow). Packets read their own flow's digest, so no packet-to-flow join is needed.
    """
    clean = drop_repeated_headers(df.filter(c(flow).isNotNull()), label)
    flows = durable(clean.select(c(label), c(flow)).distinct())
    hashed = digest(seed, c(flow))
    cuts = hash_cuts(flows, [label], hashed, _split_quota(test, validation, 3), ["_test", "_validation"])
    return _with_split(clean, cuts, [label], hashed)


def length_bins(flows: DataFrame, label: str, bins: int, test: float, validation: float) -> DataFrame:
    """(label, n_packets, bin, test_n, validation_n): flow-length bins and their quotas per label.

    The most bins that allow a stratified split are used, with quantile edges (equal edges merged). Quotas are the
    whole split's sizes shared out by bin size, rounding by largest remainder. A label where no binning works has bin 0
    only. All of this runs on the histogram of flow lengths.
    """
    histogram = flows.groupBy(label, "n_packets").agg(F.count(F.lit(1)).alias("m")).persist()
    totals = histogram.groupBy(label).agg(F.sum("m").alias("n"))
    options = [k for k in range(2, bins + 1)]

    def edges(k: int) -> Column:
        marks = F.array(*[F.lit(i / k) for i in range(k + 1)])
        return F.array_distinct(F.percentile("n_packets", marks, F.col("m")))

    quantiles = histogram.groupBy(label).agg(
        F.array(*[F.struct(F.lit(k).alias("k"), edges(k).alias("edges")) for k in options]).alias("o")
    )
    tried = quantiles.select(label, F.explode("o").alias("o")).select(label, "o.k", "o.edges")
    # a value belongs to the first bin whose upper edge is not below it
    upper = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 1, F.lit(0)))
    lower_count = F.size(F.filter(upper, lambda e: e < F.col("n_packets")))
    placed = histogram.join(tried, label).withColumn("bin", lower_count)
    per_bin = placed.groupBy(label, "k", "bin").agg(F.sum("m").alias("size"))
    n_test, _ = share_sizes(F.col("n"), test, validation)
    checked = (
        per_bin.groupBy(label, "k")
        .agg(F.count(F.lit(1)).alias("n_bins"), F.min("size").alias("smallest"))
        .join(totals, label)
        .withColumn("n_test", n_test)
        .filter((F.col("k") <= F.col("n")) & (F.col("n") >= 3))
        .filter((F.col("n_bins") >= 2) & (F.col("smallest") >= 2))
        .filter((F.col("n_test") >= F.col("n_bins")) & (F.col("n") - F.col("n_test") >= F.col("n_bins")))
    )
    best = checked.groupBy(label).agg(F.max("k").alias("k"))
    chosen = placed.join(best, [label, "k"]).select(label, "n_packets", "m", "bin")
    unbinned = histogram.join(best, label, "left_anti").select(label, "n_packets", "m", F.lit(0).alias("bin"))
    binned = chosen.union(unbinned)
    sizes = binned.groupBy(label, "bin").agg(F.sum("m").alias("size")).join(totals, label)
    quotas = _bin_quotas(sizes, label, test, validation)
    result = small_side(
        binned.select(label, "n_packets", "bin").join(quotas, [label, "bin"]).select(
            label, "n_packets", "bin", "test_n", "validation_n"
        )
    )
    histogram.unpersist()
    return result


def _shared_out(size: Column, whole: Column, draws: Column, label: str) -> Column:
    """Largest-remainder share of `draws` for a bin, ties to the lower bin; bins of a label only."""
    base = F.floor(draws * size / whole).cast("long")
    remainder = draws * size - base * whole
    every = Window.partitionBy(label)
    left = draws - F.sum(base).over(every)
    place = F.row_number().over(every.orderBy(F.desc(remainder), "bin"))
    return base + F.when((place <= left) & (remainder > 0), F.lit(1)).otherwise(F.lit(0))


def _bin_quotas(sizes: DataFrame, label: str, test: float, validation: float) -> DataFrame:
    n_test, n_val = share_sizes(F.col("n"), test, validation)
    counted = sizes.withColumn("n_test", F.when(F.col("n") >= 3, n_test).otherwise(F.lit(0))).withColumn(
        "n_val", F.when(F.col("n") >= 3, n_val).otherwise(F.lit(0))
    )
    counted = counted.withColumn("n_rest", F.col("n") - F.col("n_test"))
    rest = counted.withColumn("rest_size", _shared_out(F.col("size"), F.col("n"), F.col("n_rest"), label))
    every = Window.partitionBy(label)
    n_bins = F.count(F.lit(1)).over(every)
    feasible = (n_bins == 1) | (
        (F.min("rest_size").over(every) >= 2)
        & (F.col("n_val") >= n_bins)
        & (F.col("n_rest") - F.col("n_val") >= n_bins)
    )
    checked = rest.withColumn("n_val", F.when(feasible, F.col("n_val")).otherwise(F.lit(0)))
    kept = _shared_out(F.col("rest_size"), F.col("n_rest"), F.col("n_rest") - F.col("n_val"), label)
    return checked.withColumn("kept", kept).select(
        label,
        "bin",
        (F.col("size") - F.col("rest_size")).alias("test_n"),
        F.when(F.col("n_val") > 0, F.col("rest_size") - F.col("kept")).otherwise(F.lit(0)).alias("validation_n"),
    )


def split_flows_by_length(
    df: DataFrame,
    row_id: str,
    flow: str = "stream_id",
    label: str = "label",
    bins: int = 4,
    test: float = 0.1,
    validation: float = 0.1,
    seed: int = SEED,
) -> DataFrame:
    """`split_flows` stratified by flow length inside each label."""
    clean = drop_repeated_headers(df.filter(c(flow).isNotNull()), label)
    flows = durable(
        clean.groupBy(c(label).alias(label), c(flow).alias(flow)).agg(F.count(F.lit(1)).alias("n_packets"))
    )
    binned = flows.join(length_bins(flows, label, bins, test, validation), [label, "n_packets"])
    hashed = digest(seed, c(flow))
    group = [label, "bin"]
    quotas = binned.groupBy(*group).agg(F.max("test_n").alias("_t"), F.max("validation_n").alias("_v"))

    def quota(sizes: DataFrame) -> DataFrame:
        return sizes.join(quotas, group).select(
            *group, "n", F.col("_t").alias("_test"), (F.col("_t") + F.col("_v")).alias("_validation")
        )

    cuts = hash_cuts(binned, group, hashed, quota, ["_test", "_validation"])
    assigned = _with_split(binned, cuts, group, hashed).select(label, flow, "split", F.col("n_packets").alias("_rows"))
    return skew_join(clean, durable(assigned), [label, flow], "inner", salt_by=c(row_id), counts="_rows")


# -- sampling of flows ------------------------------------------------------------------------------------------


def _flow_target(n: Column, proportion: float, min_flows: int) -> Column:
    target = F.bround(n * F.lit(float(proportion))).cast("long")
    return F.least(F.greatest(target, F.lit(min_flows).cast("long")), n)


def sample_flows(
    df: DataFrame,
    proportion: float,
    row_id: str,
    min_flows: int = 1,
    prefer_long: bool = False,
    long_ratio: float = 0.7,
    flow: str = "stream_id",
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """All packets of `round(n * proportion)` flows per label, at least `min_flows`.

    With `prefer_long`, `ceil(target * long_ratio)` flows come from the longer half and the rest from the shorter
    half, or from any unchosen flow if the shorter half is too small.
    """
    if not 0.0 < proportion <= 1.0:
        raise ValueError("proportion must be in (0, 1]")
    clean = valid_flow_rows(df, label, flow)
    hashed = digest(seed, c(flow))
    if not prefer_long:
        flows = durable(clean.select(c(label), c(flow)).distinct())

        def quota(sizes: DataFrame) -> DataFrame:
            return sizes.withColumn("_take", _flow_target(F.col("n"), proportion, min_flows))

        cuts = hash_cuts(flows, [label], hashed, quota, ["_take"]).select(label, "_take_upto")
        return clean.join(cuts, label).filter(within_cut(hashed, "_take")).drop("_take_upto")

    flows = durable(
        clean.groupBy(c(label).alias(label), c(flow).alias(flow)).agg(F.count(F.lit(1)).alias("n_packets"))
    )
    pooled = durable(long_pool(flows, label, hashed))
    sizes = pooled.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("_pool") == "long").alias("n_long")
    )
    target = _flow_target(F.col("n_all"), proportion, min_flows)
    from_long = F.least(F.ceil(target * F.lit(float(long_ratio))).cast("long"), target, F.col("n_long"))
    planned = sizes.withColumn("_target", target).withColumn("_long", from_long)
    short_size = F.col("n_all") - F.col("n_long")
    remaining = F.col("_target") - F.col("_long")
    fits = short_size >= remaining
    # first draw: the long pool, and the short pool where it is large enough
    first = planned.select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit("long").alias("_pool"), F.col("_long").alias("_take")),
                F.struct(F.lit("short").alias("_pool"), F.when(fits, remaining).otherwise(F.lit(0)).alias("_take")),
            )
        ).alias("s"),
    ).select(label, "s.*")
    second = planned.select(label, F.when(fits, F.lit(0)).otherwise(remaining).cast("long").alias("_more"))

    def first_quota(counted: DataFrame) -> DataFrame:
        return counted.join(first, [label, "_pool"])

    cuts = hash_cuts(pooled, [label, "_pool"], hashed, first_quota, ["_take"])
    drawn = pooled.join(cuts.select(label, "_pool", "_take_upto"), [label, "_pool"])
    drawn = drawn.withColumn("_in", within_cut(hashed, "_take"))
    rest = drawn.filter(~F.col("_in"))

    def second_quota(counted: DataFrame) -> DataFrame:
        return counted.join(second, label)

    more = hash_cuts(rest, [label], hashed, second_quota, ["_more"]).select(label, "_more_upto")
    chosen = drawn.join(more, label, "left").filter(F.col("_in") | within_cut(hashed, "_more")).select(
        label, flow, F.col("n_packets").alias("_rows")
    )
    return skew_join(clean, durable(chosen), [label, flow], "inner", salt_by=c(row_id), counts="_rows")


def long_pool(flows: DataFrame, label: str, hashed: Column) -> DataFrame:
    """Mark the longer half of each label's flows `long` (ties in digest order), the others `short`.

    The flow length at which the half falls comes from the histogram of lengths; only flows of exactly that length
    need an order among themselves.
    """
    histogram = flows.groupBy(label, "n_packets").agg(F.count(F.lit(1)).alias("m"))
    longest_first = Window.partitionBy(label).orderBy(F.desc("n_packets"))
    running = longest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.withColumn("_cum", F.sum("m").over(running)).withColumn(
        "_n", F.sum("m").over(Window.partitionBy(label))
    )
    half = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(0.5))).cast("long")
    edge = small_side(
        sums.filter((F.col("_cum") >= half) & (F.col("_cum") - F.col("m") < half)).select(
            label, F.col("n_packets").alias("_edge"), (half - F.col("_cum") + F.col("m")).alias("_need")
        )
    )
    marked = flows.join(edge, label)
    tied = marked.filter(F.col("n_packets") == F.col("_edge"))

    def quota(sizes: DataFrame) -> DataFrame:
        return sizes.join(edge.select(label, F.col("_need").alias("_half")), label)

    cuts = hash_cuts(tied, [label], hashed, quota, ["_half"]).select(label, "_half_upto")
    is_long = (F.col("n_packets") > F.col("_edge")) | (
        (F.col("n_packets") == F.col("_edge")) & within_cut(hashed, "_half")
    )
    return marked.join(cuts, label, "left").select(
        label, flows.columns[1], "n_packets", F.when(is_long, F.lit("long")).otherwise(F.lit("short")).alias("_pool")
    )


# -- sampling of packets ----------------------------------------------------------------------------------------


def _sample(df: DataFrame, proportion: float, key: str, label: str, seed: int, rule) -> DataFrame:
    """Keep the first `rule(n, average)` rows of each label in digest order.

    The average is round(proportion * rows / labels).
    """
    hashed = digest(seed, c(key))

    def quota(sizes: DataFrame) -> DataFrame:
        average = F.bround(F.lit(float(proportion)) * F.sum("n") / F.count(F.lit(1))).cast("long")
        mean_size = sizes.agg(average.alias("a")).scalar()
        return sizes.withColumn("_take", rule(F.col("n"), mean_size).cast("long"))

    cuts = hash_cuts(df, [label], hashed, quota, ["_take"]).select(label, "_take_upto")
    return df.join(cuts, label).filter(within_cut(hashed, "_take")).drop("_take_upto")


def _check(proportion: float) -> None:
    if not 0.0 < proportion <= 1.0:
        raise ValueError("proportion must be in (0, 1]")


def sample_proportional(
    df: DataFrame, proportion: float, key: str, label: str = "label", seed: int = SEED
) -> DataFrame:
    """`round(n * p)` rows per label, at least one; 0 gives none, 1 gives all."""
    if not 0.0 <= proportion <= 1.0:
        raise ValueError("proportion must be in [0, 1]")
    if proportion in (0.0, 1.0):
        return df.filter(F.lit(proportion == 1.0))

    def rule(n: Column, _average: Column) -> Column:
        return F.greatest(F.bround(n * F.lit(float(proportion))), F.lit(1))

    return _sample(df, proportion, key, label, seed, rule)


def sample_hybrid(df: DataFrame, proportion: float, key: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """Labels up to the average size whole, others `max(round(n * p), average)` rows."""
    _check(proportion)
    if proportion == 1.0:
        return df

    def rule(n: Column, average: Column) -> Column:
        return F.when(n <= average, n).otherwise(F.greatest(F.bround(n * F.lit(float(proportion))), average))

    return _sample(df, proportion, key, label, seed, rule)


def sample_capped(df: DataFrame, proportion: float, key: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """Labels up to the average size whole, all others cut to the average."""
    _check(proportion)
    return _sample(df, proportion, key, label, seed, F.least)


def balance(df: DataFrame, proportion: float, key: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """Every label to exactly the average size (at least 1), rows of short labels repeated; adds `copy`.

    Rows are repeated evenly: each `average // n` times, and the first `average % n` in digest order once more.
    A row with more than `COPIES` copies is cut into pieces of so many, which are spread before they are repeated.
    """
    _check(proportion)
    hashed = digest(seed, c(key))

    def quota(sizes: DataFrame) -> DataFrame:
        whole = sizes.agg(
            F.greatest(F.bround(F.lit(float(proportion)) * F.sum("n") / F.count(F.lit(1))), F.lit(1)).alias("a")
        ).scalar()
        size = whole.cast("long")
        return sizes.select(
            label,
            "n",
            F.when(F.col("n") >= size, size).otherwise(F.pmod(size, F.col("n"))).cast("long").alias("_extra"),
            F.when(F.col("n") >= size, F.lit(0)).otherwise(F.floor(size / F.col("n"))).cast("long").alias("_times"),
        )

    cuts = hash_cuts(df, [label], hashed, quota, ["_extra"]).select(label, "_times", "_extra_upto")
    copies = F.col("_times") + within_cut(hashed, "_extra").cast("long")
    kept = df.join(cuts, label).withColumn("_copies", copies).filter(F.col("_copies") > 0)
    one = F.lit(1).cast("long")
    few = kept.filter(F.col("_copies") <= COPIES).withColumn("copy", F.explode(F.sequence(one, F.col("_copies"))))
    begin = F.col("_piece") * COPIES
    pieces = kept.filter(F.col("_copies") > COPIES).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES)))
    )
    # a given number of partitions: adaptive execution would merge them, as pieces are small before they are repeated
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pieces.repartition(partitions, c(key), F.col("_piece")).withColumn(
        "copy", F.explode(F.sequence(begin + 1, F.least(begin + COPIES, F.col("_copies"))))
    )
    return few.unionByName(many.drop("_piece")).drop("_times", "_extra_upto", "_copies")

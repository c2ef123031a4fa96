"""Building blocks that keep skewed or huge groups out of a single task.

Every operator that needs an order, a rank, a median, a lookup join or a top-n inside a group goes through
one of these, so that a group holding a large part of all rows is split, and nothing is broadcast before its
size has been checked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import durable, stored

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
SALTS = 64
RANGES = 4096
#: Keys that one window ranks; more are ranked in ranges.
FEW_KEYS = 8192
DIGEST_DIGITS = 4


def quoted(name: str) -> str:
    """A column name safe to use in `F.col`, dots included."""
    return f"`{name}`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def small_rows(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame | None:
    """`df` as a local relation with a broadcast hint if it is small, else None.

    At most `max_rows + 1` rows are fetched to find out.
    """
    probe = df.limit(max_rows + 1).toArrow()
    if probe.num_rows <= max_rows and probe.nbytes <= max_bytes:
        return F.broadcast(df.sparkSession.createDataFrame(probe, schema=df.schema))
    return None


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` ready to be a join's small side: broadcast if its size allows, else checkpointed and without a hint."""
    local = small_rows(df, max_rows, max_bytes)
    return local if local is not None else durable(df)


def digest(seed: int | str, *parts: Column) -> Column:
    """Sampling order: md5 of the seed and the key parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[part.cast("string") for part in parts]))


def unit_uniform(hashed: Column, start: int) -> Column:
    """A number in (0, 1] from eight hex digits of a digest."""
    return (F.conv(F.substring(hashed, start, 8), 16, 10).cast("double") + 1) / F.lit(float(2**32))


def sorted_rank(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    within: Sequence[str] = (),
    name: str = "rank",
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """1-based position in `order` inside each `within` group, without sorting a whole group in one task.

    `bucket` must not decrease along `order`. Bucket sizes are summed up to offsets, so the only window over the
    rows themselves is one per (group, bucket). `sizes_of` is a cheaper table of the same rows to take the sizes from.
    """
    keys = [*within, "_bucket"]
    keyed = df.withColumn("_bucket", bucket)
    counted = keyed if sizes_of is None else sizes_of.withColumn("_bucket", bucket)
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = keyed.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        inside.join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_bucket", "_offset", "_pos")
    )


def range_edges(df: DataFrame, column: str, ranges: int = RANGES) -> list[float]:
    """Edges of ranges of a numeric column that hold about equally many rows, from a quantile sketch."""
    return sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.5 / ranges)))


def with_ranges(
    df: DataFrame, column: str, name: str, ranges: int = RANGES, edges: Sequence[float] | None = None
) -> DataFrame:
    """Add a range number that never decreases along a numeric column; ranges hold about equally many rows.

    The edges come from a quantile sketch, so that outliers don't push all other rows into one range.
    """
    edges = range_edges(df, column, ranges) if edges is None else edges
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def rank_by_number(
    df: DataFrame,
    column: str,
    within: Sequence[str] = (),
    name: str = "rank",
    keys: DataFrame | None = None,
    few: int = FEW_KEYS,
) -> DataFrame:
    """Position by a unique numeric column inside each `within` group, in ranges of about equally many rows.

    The sketch of the ranges, their sizes and the count read `keys`, a stored table of the same rows with `within` and
    the column; without one `df` is stored and ranked from there. A few rows take a plain window and no sketch.
    """
    if keys is None:
        df = keys = stored(df, "keys")
    if keys.count() <= few:
        line = Window.partitionBy(*(within or [F.lit(0)])).orderBy(column)
        return df.withColumn(name, F.row_number().over(line).cast("long"))
    edges = range_edges(keys, column)
    ranged, sized = (with_ranges(table, column, "_range", edges=edges) for table in (df, keys))
    return sorted_rank(ranged, [F.col(column)], F.col("_range"), within, name, sized).drop("_range")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, counts: str | None = None) -> DataFrame:
    """(keys, _n) of the keys with more than `hot_rows` rows, so at most one per `hot_rows` rows of the table.

    `counts` names a column of row counts when `df` is already aggregated.
    """
    weight = F.sum(counts) if counts else F.count(F.lit(1))
    return df.groupBy(*keys).agg(weight.alias("_n")).filter(F.col("_n") > hot_rows)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys, the hot keys with their counts `_n`).

    The last two are None if no key is hot. The hot keys are broadcast only while they are few. Rows with a null key
    count as ordinary. `counts` is a materialised table (keys, `_rows`), if there is one; then `df` isn't counted.
    """
    keys = list(keys)
    found = hot_keys(df, keys, hot_rows) if counts is None else hot_keys(counts, keys, hot_rows, "_rows")
    hot = small_side(found.dropna(subset=[quoted(k) for k in keys]))
    if hot.isEmpty():
        return df, None, None
    columns = [quoted(name) for name in df.columns]
    return df.join(hot, keys, "left_anti").select(*columns), df.join(hot, keys, "left_semi").select(*columns), hot


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salt_by: Column | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int | None = None,
    counts: str | None = None,
) -> DataFrame:
    """Join many rows to one row per key; hot keys of `left` are salted and their `right` rows replicated.

    A hot key gets `salts` parts; by default as many as it has times `hot_rows` rows, so that a part stays that size
    however hot the key is. Without any hot key this is a plain join.

    `counts` names a column of `right` (dropped here) with the rows that `left` has per key. The hot keys come from it,
    and `left` is read only once; `right` must then be materialised, and is broadcast if it is small.
    """
    keys = list(keys)
    if counts is None:
        _, _, hot = split_hot(left, keys, hot_rows)
    else:
        known = right.select(*[c(k) for k in keys], c(counts).alias("_rows"))
        right = right.drop(counts)
        local = small_rows(right)
        if local is not None:
            return left.join(local, keys, how)
        _, _, hot = split_hot(left, keys, hot_rows, known)
    if hot is None:
        return left.join(right, keys, how)
    parts = F.lit(salts) if salts is not None else F.ceil(F.col("_n") / hot_rows)
    flagged = hot.select(*[c(k) for k in keys], parts.cast("int").alias("_parts"))
    part = salt_by if salt_by is not None else F.xxhash64(*[c(name) for name in left.columns])
    parts = F.coalesce("_parts", F.lit(1))
    salted_left = (
        left.join(flagged, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(part), parts).cast("int"))
        .drop("_parts")
    )
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    salted_right = right.join(flagged, keys, "left").withColumn("_salt", copies).drop("_parts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt_by: Column,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The first `n` rows of each group.

    Ordinary groups take one window, which Spark limits to n rows per group before its shuffle. Hot groups are cut in
    salted parts first, so that their survivors are few. `counts` as in `split_hot`.
    """

    def first(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*[quoted(k) for k in by]).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    ordinary, hot_part, _ = split_hot(df, keys, hot_rows, counts)
    if hot_part is None:
        return first(ordinary, keys)
    salted = hot_part.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    return first(ordinary, keys).unionByName(first(first(salted, [*keys, "_salt"]), keys).drop("_salt"))


def hash_cuts(
    df: DataFrame,
    group: Sequence[str],
    hashed: Column,
    quota: Callable[[DataFrame], DataFrame],
    cuts: Sequence[str],
    digits: int = DIGEST_DIGITS,
) -> DataFrame:
    """Per group, the digest of the k-th row in digest order for each cut size k.

    `quota` turns the table (group, n) into one that also has a row count per name in `cuts`. A row then belongs to
    the first k rows of its group exactly if its digest is at most the threshold, which is a plain filter: the data
    is neither sorted nor shuffled by group. The result has the columns of `quota` plus `<cut>_upto` (null for
    k = 0). Digests must be unique inside a group.
    """
    group = list(group)
    keyed = df.select(*group, hashed.alias("_h")).withColumn("_b", F.substring("_h", 1, digits))
    histogram = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c")).persist()
    sizes = histogram.groupBy(*group).agg(F.sum("_c").alias("n"))
    wanted = small_side(quota(sizes))
    running = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.withColumn("_cum", F.sum("_c").over(running))
    named = [F.struct(F.lit(cut).alias("_cut"), F.least(F.col(cut), F.col("n")).alias("_k")) for cut in cuts]
    edges = small_side(
        sums.join(wanted.select(*group, "n", F.explode(F.array(*named)).alias("_s")), group)
        .select(*group, "_b", "_c", "_cum", "_s._cut", "_s._k")
        .filter((F.col("_k") <= F.col("_cum")) & (F.col("_k") > F.col("_cum") - F.col("_c")))
        .select(*group, "_b", "_cut", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_need"))
    )
    inside = keyed.join(edges.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    position = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h"))
    upto = (
        inside.withColumn("_pos", position)
        .join(edges, [*group, "_b"])
        .filter(F.col("_pos") == F.col("_need"))
        .groupBy(*group)
        .agg(*[F.max(F.when(F.col("_cut") == cut, F.col("_h"))).alias(f"{cut}_upto") for cut in cuts])
    )
    result = small_side(wanted.join(upto, group, "left"))
    histogram.unpersist()
    return result


def within_cut(hashed: Column, cut: str) -> Column:
    """Is this row among the first rows counted by `cut`?"""
    return F.coalesce(hashed <= F.col(f"{cut}_upto"), F.lit(False))


def magnitude_bucket(value: Column) -> Column:
    """A bucket number in the order of the values, 512 per power of two: tiny values spread as large ones do."""
    # 1100 is above the exponent of every double, so that both signs count away from 0
    steps = F.floor((F.log2(F.abs(value)) + 1100) * 512)
    return F.when(value > 0, steps).when(value < 0, -steps).otherwise(F.lit(0)).cast("long")


def exact_medians(df: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Exact median per column (and group) as rows (within, feature, median).

    A histogram over log-scaled buckets finds the bucket of the middle rows; only that bucket is looked at in
    detail, as counts per distinct value.
    """
    long = (
        df.select(
            *within,
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("v")) for n in columns])
            ).alias("_s"),
        )
        .select(*within, "_s.feature", "_s.v")
        .filter(F.col("v").isNotNull())
        .withColumn("_b", magnitude_bucket(F.col("v")))
    )
    key = [*within, "feature"]
    histogram = long.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*key)
    sums = histogram.withColumn("_cum", F.sum("_c").over(running)).withColumn("_n", F.sum("_c").over(everything))
    middles = F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)
    edges = small_side(
        sums.withColumn("_k", F.explode(middles))
        .filter((F.col("_k") <= F.col("_cum")) & (F.col("_k") > F.col("_cum") - F.col("_c")))
        .select(*key, "_b", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_need"))
    )
    inside = long.join(edges.select(*key, "_b").distinct(), [*key, "_b"], "left_semi")
    values = inside.groupBy(*key, "_b", "v").agg(F.count(F.lit(1)).alias("_c"))
    by_value = Window.partitionBy(*key, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        values.withColumn("_cum", F.sum("_c").over(by_value))
        .join(edges, [*key, "_b"])
        .filter((F.col("_need") <= F.col("_cum")) & (F.col("_need") > F.col("_cum") - F.col("_c")))
        .groupBy(*key)
        .agg(F.avg("v").alias("median"))
    )

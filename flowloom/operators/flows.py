"""Flow identity, per-flow statistics and their attachment to packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import hex_to_long, norm_hex, segment_numbers, tsval
from flowloom.operators.columns import wide_to_long
from flowloom.scale import (
    HOT_ROWS,
    c,
    digest,
    exact_medians,
    rank_by_number,
    skew_join,
    small_side,
    sorted_rank,
    split_hot,
    top_per_group,
)
from flowloom.session import durable, stored

# fixed values: column and feature names of the packet tables
FIVE_TUPLE = ("ip.src", "ip.dst", "tcp.srcport", "tcp.dstport", "ip.proto")
TIME_COLUMNS = ("tcp.options.timestamp", "frame.time_relative", "frame.time_epoch")
LARGE_PACKET = 1400
EPSILON = 1e-6
#: Chunks that a hot flow is cut into at once, by quantiles (a power of two), and the sketch's accuracy.
CHUNKS, ACCURACY = 256, 10_000
LENGTH_FEATURES = ("flow_avg_len", "flow_std_len", "flow_pkt_count", "flow_large_pkt_ratio")
TIME_FEATURES = ("flow_avg_iat", "flow_std_iat", "flow_max_iat", "flow_duration_per_pkt")
CLOSED_WORLD_FEATURES = ("flow_avg_len", "flow_std_len", "flow_pkt_count")


# -- flow identity ----------------------------------------------------------------------------------------------


def stream_key(df: DataFrame) -> Column:
    """Direction-free five-tuple key `proto|low endpoint|high endpoint`."""
    missing = [name for name in FIVE_TUPLE if name not in df.columns]
    if missing:
        raise KeyError(f"cannot build the flow key, missing columns: {missing}")
    src_ip, dst_ip, src_port, dst_port, proto = [norm_hex(c(name)) for name in FIVE_TUPLE]
    here = F.concat_ws(":", src_ip, src_port)
    there = F.concat_ws(":", dst_ip, dst_port)
    return F.concat_ws("|", proto, F.least(here, there), F.greatest(here, there))


def first_rows(df: DataFrame, key: Column, name: str, order_by: str) -> DataFrame:
    """(name, _first, _rows) per key: least row order and rows. Stored, so that ranks and hot keys come from one scan."""
    keyed = df.select(key.alias(name), c(order_by).alias("_order"))
    return stored(keyed.groupBy(name).agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_rows")), "keys")


def _numbered(first: DataFrame, code: str) -> DataFrame:
    """`first_rows` with dense ranks from 1 in order of first appearance."""
    return rank_by_number(first, "_first", name=code, keys=first)


def stream_ids(df: DataFrame, order_by: str) -> DataFrame:
    """(stream_key, stream_id): dense ids from 1 in order of first appearance."""
    return _numbered(first_rows(df, stream_key(df), "stream_key", order_by), "stream_id").select("stream_key", "stream_id")


def add_stream_id(df: DataFrame, order_by: str, drop_tcp_stream: bool = True) -> DataFrame:
    """Add `stream_id`; only distinct keys are ranked, and hot flows, known from their counts, are salted."""
    keyed = df.withColumn("stream_key", stream_key(df))
    ids = _numbered(first_rows(df, stream_key(df), "stream_key", order_by), "stream_id").drop("_first")
    joined = skew_join(keyed, ids, ["stream_key"], salt_by=c(order_by), counts="_rows").drop("stream_key")
    return joined.drop("tcp.stream") if drop_tcp_stream and "tcp.stream" in df.columns else joined


def flow_number(column: Column) -> Column:
    """Flow id as a number; null or non-numeric text is flow -1."""
    whole = column.try_cast("bigint")
    return F.coalesce(whole, column.try_cast("double").try_cast("bigint"), F.lit(-1).cast("bigint"))


def factorize(df: DataFrame, key: str, order_by: str, code: str) -> DataFrame:
    """(key, code): dense codes from 0 by first appearance, nulls share one code."""
    ranked = _numbered(first_rows(df, c(key), key, order_by), "_rank")
    return ranked.select(c(key), (F.col("_rank") - 1).alias(code))


def reassembly(packets: DataFrame, frame: str, text: Column, member_list: str = "reassembled") -> DataFrame:
    """Give every frame the segment list of the last frame that reassembles it, outer-joined on the frame number.

    A frame starts with an empty list when it is read, so only lists from the same or a later frame reach it; a
    member that is not a frame of the table takes the last list naming it.
    """
    lists = packets.select(c(frame).alias("frame_num"), segment_numbers(text).alias("_list")).filter(
        F.size("_list") > 0
    )
    members = lists.select("frame_num", "_list", F.explode("_list").alias("_member"))
    last = members.groupBy(F.col("_member").alias("frame_num")).agg(
        F.max_by("_list", "frame_num").alias("_any"),
        F.max_by("_list", F.when(F.col("frame_num") >= F.col("_member"), F.col("frame_num"))).alias("_later"),
    )
    known = packets.withColumn("frame_num", c(frame)).withColumn("_known", F.lit(True))
    empty = F.array().cast("array<bigint>")
    return (
        known.join(last, "frame_num", "full_outer")
        .withColumn(
            member_list,
            F.when(F.col("_known"), F.coalesce("_later", empty)).otherwise(F.col("_any")),
        )
        .drop("_any", "_later", "_known")
    )


# -- per-flow statistics ----------------------------------------------------------------------------------------


def pick_time_column(df: DataFrame, candidates: Sequence[str] = TIME_COLUMNS) -> str | None:
    return next((name for name in candidates if name in df.columns), None)


def packet_time(name: str) -> Column:
    """TSval for the timestamp option, else the decimal text; 0 where unreadable."""
    if name == "tcp.options.timestamp":
        return tsval(c(name)).cast("double")
    return F.coalesce(c(name).try_cast("double"), F.lit(0.0))


def _length_features() -> list[Column]:
    return [
        F.avg("_len").alias("flow_avg_len"),
        F.coalesce(F.stddev_samp("_len"), F.lit(0.0)).alias("flow_std_len"),
        F.count("_len").alias("flow_pkt_count"),
        (F.count_if(F.col("_len") > LARGE_PACKET) / (F.count("_len") + F.lit(EPSILON))).alias("flow_large_pkt_ratio"),
    ]


def length_stats(df: DataFrame, flow: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Average, deviation, count and large-packet share per flow: partial sums, no skew."""
    length = hex_to_long(c("ip.len")).cast("double")
    narrow = df.select(*keys, flow.alias("flow"), length.alias("_len"))
    return narrow.groupBy(*keys, "flow").agg(*_length_features())


def place_among(value: Column, edges: Column) -> Column:
    """How many of `CHUNKS` - 1 sorted edges are below the value, by binary search."""
    steps = F.array(*[F.lit(CHUNKS >> k) for k in range(1, CHUNKS.bit_length())])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) < value, step).otherwise(F.lit(0))
    )


def quantile_chunks(times: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Add `_chunk`, which never decreases along `t` inside a key; no chunk has more than `rows` rows.

    `times` has one row per (keys, t). The edges are quantiles, from a sketch per key and, where a chunk is still too
    large, per chunk. So a burst is cut as finely as a long time line, and bounds on neither have to be known.
    """
    marks = [k / CHUNKS for k in range(1, CHUNKS)]
    by = [*keys, "_chunk"]
    placed = times.withColumn("_chunk", F.lit(0).cast("long"))
    while True:
        sketch = F.percentile_approx("t", marks, ACCURACY).alias("_edges")
        sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), sketch)
        large = small_side(sizes.filter(F.col("_size") > rows).drop("_size"))
        if large.isEmpty():
            return placed
        inside = F.coalesce(place_among(F.col("t"), F.col("_edges")), F.lit(0))
        cut = placed.join(large, by, "left").withColumn("_chunk", F.col("_chunk") * CHUNKS + inside)
        placed = stored(cut.select(*placed.columns), "chunks")


def gap_chunks(times: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Gaps between the distinct times of each key, with the time line cut into chunks of at most `rows` times.

    `times` has one row per (keys, t). Adds `_chunk` and `gap`; the first time of a chunk has a null gap.
    """
    chunked = quantile_chunks(times, keys, rows)
    line = Window.partitionBy(*keys, "_chunk").orderBy("t")
    return chunked.withColumn("gap", F.col("t") - F.lag("t").over(line))


def _stats_by_window(timed: DataFrame, group: Sequence[str]) -> DataFrame:
    """All features of ordinary flows from one window and one aggregate, which share their shuffle.

    The first packet of a flow counts with gap 0.
    """
    line = Window.partitionBy(*group).orderBy("t")
    gap = F.coalesce(F.col("t") - F.lag("t").over(line), F.lit(0.0))
    return (
        timed.withColumn("_gap", gap)
        .groupBy(*group)
        .agg(
            *_length_features(),
            F.avg("_gap").alias("flow_avg_iat"),
            F.coalesce(F.stddev_samp("_gap"), F.lit(0.0)).alias("flow_std_iat"),
            F.max("_gap").alias("flow_max_iat"),
            ((F.max("t") - F.min("t")) / (F.count(F.lit(1)) + F.lit(EPSILON))).alias("flow_duration_per_pkt"),
        )
    )


def _time_stats_by_chunks(timed: DataFrame, group: Sequence[str], rows: int) -> DataFrame:
    """Gap and duration features of huge flows, without a window over a whole flow.

    Equal times are collapsed first (their gaps are 0), then gaps are taken inside chunks of the time line, and chunk
    moments are merged with the gaps between chunks. A window sees one chunk, or one row per chunk.
    """
    times = stored(timed.groupBy(*group, "t").agg(F.count(F.lit(1)).alias("_n")), "times")
    chunks = (
        gap_chunks(times, group, rows)
        .groupBy(*group, "_chunk")
        .agg(
            F.sum("_n").alias("_n"),
            F.count("gap").alias("_k"),
            F.coalesce(F.avg("gap"), F.lit(0.0)).alias("_mean"),
            F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("_var"),
            F.max("gap").alias("_max"),
            F.min("t").alias("_t0"),
            F.max("t").alias("_t1"),
        )
    )
    line = Window.partitionBy(*group).orderBy("_chunk")
    flow_wide = Window.partitionBy(*group)
    placed = chunks.select(
        "*",
        (F.col("_t0") - F.lag("_t1").over(line)).alias("_jump"),
        F.sum("_n").over(flow_wide).alias("_total"),
        (F.max("_t1").over(flow_wide) - F.min("_t0").over(flow_wide)).alias("_span"),
    ).withColumn("_avg", F.col("_span") / F.col("_total"))
    inner = F.col("_k") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_avg"), F.lit(2.0)))
    jump = F.coalesce(F.pow(F.col("_jump") - F.col("_avg"), F.lit(2.0)), F.lit(0.0))
    n, total = F.first("_total"), F.first("_avg")
    zeros = n - F.sum("_k") - F.count("_jump")
    squares = F.sum(inner + jump) + zeros * total * total
    return placed.groupBy(*group).agg(
        total.alias("flow_avg_iat"),
        F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))).otherwise(F.lit(0.0)).alias("flow_std_iat"),
        F.coalesce(F.greatest(F.max("_max"), F.max("_jump")), F.lit(0.0)).alias("flow_max_iat"),
        (F.first("_span") / (n + F.lit(EPSILON))).alias("flow_duration_per_pkt"),
    )


def flow_stats(
    df: DataFrame,
    flow: str = "stream_id",
    time_columns: Sequence[str] = TIME_COLUMNS,
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per-flow features, keyed by `flow` (and `keys`, for example the split).

    The packets are scanned once, into a stored table of (keys, flow, length, time). Hot flows are found there; none can
    be hot in a table of fewer rows.
    """
    if "ip.len" not in df.columns or flow not in df.columns:
        raise KeyError(f"flow statistics need 'ip.len' and '{flow}'")
    number = flow_number(c(flow))
    time_column = pick_time_column(df, time_columns)
    if time_column is None:
        return length_stats(df, number, keys)
    length, time = hex_to_long(c("ip.len")).cast("double"), packet_time(time_column)
    timed = stored(df.select(*keys, number.alias("flow"), length.alias("_len"), time.alias("t")), "timed")
    group = [*keys, "flow"]
    if timed.count() <= hot_rows:
        return _stats_by_window(timed, group)
    ordinary, hot_part, _ = split_hot(timed, group, hot_rows)
    stats = _stats_by_window(ordinary, group)
    if hot_part is None:
        return stats
    lengths = hot_part.groupBy(*group).agg(*_length_features())
    return stats.unionByName(lengths.join(_time_stats_by_chunks(hot_part, group, hot_rows), group))


def feature_names(stats: DataFrame) -> list[str]:
    return [name for name in stats.columns if name.startswith("flow_")]


# -- attaching statistics to packets ----------------------------------------------------------------------------


def default_values(stats: DataFrame, rule: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key) of defaults named `<feature>_default`.

    `mean`: means of all. `open_world`: means, the count truncated to an integer. `mixed`: mean for counts and ratios,
    exact median for the rest. `zero`: zeros.
    """
    names = feature_names(stats)

    def mean_of(name: str) -> Column:
        return F.coalesce(F.avg(name), F.lit(0.0))

    if rule == "zero":
        rows = stats.select(*keys).distinct() if keys else stats.sparkSession.range(1)
        return rows.select(*keys, *[F.lit(0.0).alias(f"{n}_default") for n in names])
    if rule == "mean":
        return stats.groupBy(*keys).agg(*[mean_of(n).alias(f"{n}_default") for n in names])
    if rule == "open_world":
        return stats.groupBy(*keys).agg(
            *[
                (F.floor(mean_of(n)).cast("double") if "count" in n else mean_of(n)).alias(f"{n}_default")
                for n in names
            ]
        )
    if rule != "mixed":
        raise ValueError(f"unknown default rule: {rule}")
    averaged = [n for n in names if "count" in n or "ratio" in n]
    middle = [n for n in names if n not in averaged]
    means = wide_to_long(
        stats.groupBy(*keys).agg(*[mean_of(n).alias(n) for n in averaged]), averaged, "feature", "value"
    )
    values = means.unionByName(exact_medians(stats, middle, keys).withColumnRenamed("median", "value"))
    return values.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)).alias(f"{n}_default")
            for n in names
        ]
    )


def attach(packets: DataFrame, stats: DataFrame, defaults: DataFrame, flow: str, row_id: str,
           keys: Sequence[str] = ()) -> DataFrame:
    """Left join of flow features, missing flows filled with the defaults; hot flows are salted.

    `stats` is materialised; its packet counts tell the hot flows.
    """
    names = feature_names(stats)
    numbered = packets.withColumn("flow", flow_number(c(flow)))
    counted = stats.withColumn("_rows", F.col("flow_pkt_count"))
    joined = skew_join(numbered, counted, [*keys, "flow"], salt_by=c(row_id), counts="_rows")
    if keys:
        filled = joined.join(small_side(defaults), list(keys), "left")
    else:
        row = defaults.first().asDict()
        filled = joined.withColumns({name: F.lit(value) for name, value in row.items()})
    return filled.select(
        *[c(name) for name in packets.columns],
        *[F.coalesce(F.col(n).cast("double"), F.col(f"{n}_default")).alias(n) for n in names],
    )


def flow_features(
    packets: DataFrame,
    mode: str,
    row_id: str,
    flow: str = "stream_id",
    split: str = "split",
    full: DataFrame | None = None,
    time_columns: Sequence[str] = TIME_COLUMNS,
) -> DataFrame:
    """Packets with flow features.

    `full` holds the packets the statistics come from when `packets` were capped. Modes: `per_split` uses the
    statistics and mixed defaults of each packet's own split; `open_world` those of the train split with mean
    defaults; `closed_world` each split's own length statistics with mean defaults; `source` the whole table, missing 0.
    Statistics that both the defaults and the join read are checkpointed, so packets are aggregated once.
    """
    source = packets if full is None else full
    if mode == "per_split":
        stats = durable(flow_stats(source, flow, time_columns, [split]))
        return attach(packets, stats, default_values(stats, "mixed", [split]), flow, row_id, [split])
    if mode == "open_world":
        stats = durable(flow_stats(source.filter(c(split) == "train"), flow, time_columns))
        return attach(packets, stats, default_values(stats, "open_world"), flow, row_id)
    if mode == "closed_world":
        stats = durable(flow_stats(source, flow, (), [split]).select(split, "flow", *CLOSED_WORLD_FEATURES))
        return attach(packets, stats, default_values(stats, "mean", [split]), flow, row_id, [split])
    if mode == "source":
        stats = durable(flow_stats(source, flow, time_columns))
        return attach(packets, stats, default_values(stats, "zero"), flow, row_id)
    raise ValueError(f"unknown flow feature mode: {mode}")


def direction_and_gap(
    df: DataFrame,
    row_id: str,
    flow: str = "stream_id",
    time_columns: Sequence[str] = TIME_COLUMNS,
    hot_rows: int = HOT_ROWS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add `flow_dir_sign` and `flow_iat_local` per packet.

    +1 if the endpoints equal those of the flow's first packet (per column the first non-null one), else -1; by
    address, else by port, else 0. The gap is the time since the flow's previous packet, 0 for the first. Ties in time
    keep table order. With `keys` (such as the split) packets of a flow count together only where these agree, so that
    nothing of a test packet reaches the training rows.

    `row_id` is unique. Windows see a stored table of (row id, keys, flow, time, endpoints) only, and the result is joined
    back, so that no wide row is sorted by flow or held in a window. Ordinary flows take one window; hot ones are
    aggregated and cut into chunks instead.
    """
    time_column = pick_time_column(df, time_columns)
    pairs = (("ip.src", "ip.dst"), ("tcp.srcport", "tcp.dstport"))
    ends = next((pair for pair in pairs if set(pair) <= set(df.columns)), ())
    time = packet_time(time_column) if time_column else F.lit(0.0)
    by = [*[f"_key{i}" for i in range(len(keys))], "_flow"]
    narrow = stored(
        df.select(
            c(row_id).alias("_row"),
            *[c(key).alias(name) for key, name in zip(keys, by, strict=False)],
            flow_number(c(flow)).alias("_flow"),
            time.alias("_t"),
            *[c(name).alias(f"_end{i}") for i, name in enumerate(ends)],
        ),
        "context",
    )
    ordinary, hot_part = narrow, None
    if narrow.count() > hot_rows:
        ordinary, hot_part, _ = split_hot(narrow, by, hot_rows)
    result = _context_by_window(ordinary, len(ends), by)
    if hot_part is not None:
        result = result.unionByName(_context_by_chunks(hot_part, len(ends), by, hot_rows))
    if ends:
        same = [F.coalesce(f"_end{i}", F.lit("")) == F.coalesce(f"_first{i}", F.lit("")) for i in range(2)]
        sign = F.when(same[0] & same[1], F.lit(1.0)).otherwise(F.lit(-1.0))
    else:
        sign = F.lit(0.0)
    context = result.select("_row", sign.alias("flow_dir_sign"), F.coalesce("_gap", F.lit(0.0)).alias("flow_iat_local"))
    found = df.withColumn("_row", c(row_id)).join(small_side(context), "_row", "left")
    return found.select(*[c(name) for name in df.columns], "flow_dir_sign", "flow_iat_local")


def _context_by_window(narrow: DataFrame, ends: int, by: Sequence[str]) -> DataFrame:
    """Add `_first<i>` and `_gap` by a window per flow."""
    line = Window.partitionBy(*by).orderBy("_t", "_row")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = {f"_first{i}": F.first(f"_end{i}", ignorenulls=True).over(whole) for i in range(ends)}
    return narrow.withColumns({**firsts, "_gap": F.col("_t") - F.lag("_t").over(line)})


def _context_by_chunks(narrow: DataFrame, ends: int, by: Sequence[str], rows: int) -> DataFrame:
    """The same for few huge flows, without a window over a whole flow.

    First endpoints are aggregates, one broadcast row per hot flow. Only the first packet of each distinct time can
    have a gap, and that one is found by its own id.
    """
    result = narrow
    if ends:
        order = F.struct("_t", "_row")
        firsts = [F.min_by(f"_end{i}", F.when(F.col(f"_end{i}").isNotNull(), order)).alias(f"_first{i}") for i in range(ends)]
        result = narrow.join(small_side(narrow.groupBy(*by).agg(*firsts)), list(by))
    times = stored(narrow.groupBy(*by, F.col("_t").alias("t")).agg(F.min("_row").alias("_at")), "times")
    chunk_end = F.max("t").over(Window.partitionBy(*by, "_chunk"))
    gaps = gap_chunks(times, list(by), rows).withColumn("_end", chunk_end)
    # the first time of a chunk is one row per chunk; it looks back at the end of the chunk before
    line = Window.partitionBy(*by).orderBy("_chunk")
    across = gaps.filter(F.col("gap").isNull()).withColumn("gap", F.col("t") - F.lag("_end").over(line))
    row_gaps = gaps.filter(F.col("gap").isNotNull()).unionByName(across).select(F.col("_at").alias("_row"), F.col("gap").alias("_gap"))
    return result.join(row_gaps, "_row", "left")


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Unreadable, NaN and infinite values to 0; counts as int, the rest as float."""

    def clean(name: str) -> Column:
        number = c(name).try_cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
        kept = F.when(bad, F.lit(0.0)).otherwise(number)
        return (kept.cast("int") if "count" in name else kept.cast("float")).alias(name)

    return df.select(*[clean(name) if name in set(features) else c(name) for name in df.columns])


# -- packets of a flow ------------------------------------------------------------------------------------------


def cap_packets(df: DataFrame, cap: int | None, seed: int, row_id: str, flow: str = "stream_id") -> DataFrame:
    """At most `cap` packets per flow, the first ones in seeded digest order."""
    if not cap or cap <= 0:
        return df
    order = digest(seed, c(row_id))
    return top_per_group(df, [flow], [order], cap, c(row_id))


def first_n(df: DataFrame, n: int, order_by: str, flow: str = "stream_id") -> DataFrame:
    """The first n packets of each flow in table order."""
    return top_per_group(df, [flow], [c(order_by)], n, c(order_by))


def flow_batches(
    df: DataFrame,
    packets_per_flow: int,
    flows_per_batch: int,
    order_by: str,
    flow: str = "stream_id",
    seed: int | None = None,
    drop_last: bool = False,
) -> DataFrame:
    """Add `batch_id`: K flows per batch, each with its first n packets.

    Flows come in order of first appearance, or in digest order of their id when a seed is given.
    """
    flows = first_rows(df, c(flow), flow, order_by)
    kept = top_per_group(df, [flow], [c(order_by)], packets_per_flow, c(order_by), counts=flows)
    if seed is None:
        ranked = _numbered(flows, "_rank")
    else:
        hashed = flows.withColumn("_h", digest(seed, c(flow)))
        ranked = sorted_rank(hashed, [F.col("_h")], F.substring("_h", 1, 4), name="_rank")
    batches = ranked.select(
        c(flow), F.floor((F.col("_rank") - 1) / flows_per_batch).cast("long").alias("batch_id")
    )
    if drop_last:
        batches = batches.filter(F.col("batch_id") < flows.count() // flows_per_batch)
    return kept.join(small_side(batches), flow)


def sampling_summary(df: DataFrame, flow: str = "stream_id", label: str = "label") -> DataFrame:
    """Flows, packets and their shares per label; flows are made distinct before they are counted."""
    pairs = df.groupBy(c(label).alias("_label"), c(flow).alias("_flow")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per flow with its few labels; the extra entry without a label counts the flow once for the totals
    entry = F.struct(F.col("_label").alias("label"), F.col("_n").alias("n"), F.lit(False).alias("is_total"))
    total = F.struct(F.lit(None).cast("string").alias("label"), F.sum("_n").alias("n"), F.lit(True).alias("is_total"))
    per_flow = pairs.groupBy("_flow").agg(F.concat(F.collect_list(entry), F.array(total)).alias("e"))
    counts = (
        per_flow.select("_flow", F.explode("e").alias("e"))
        .groupBy("e.label", "e.is_total")
        .agg(F.count("_flow").alias("flows"), F.sum("e.n").alias("packets"))
    )
    everything = Window.partitionBy(F.lit(0))

    def share(name: str) -> Column:
        whole = F.max(F.when(F.col("is_total"), F.col(name))).over(everything)
        return F.col(name) / F.greatest(whole, F.lit(1))

    shares = counts.withColumn("flow_ratio", share("flows")).withColumn("packet_ratio", share("packets"))
    return shares.filter(~F.col("is_total")).drop("is_total")

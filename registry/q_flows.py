"""Queries for flow identity, flow statistics and packets of a flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import flows
from flowloom.scale import c
from registry.core import query
from registry.fixtures import SPLIT, packets, with_views

R = 3
STAT_NAMES = [*flows.LENGTH_FEATURES, *flows.TIME_FEATURES]


def rounded(df, names):
    return df.select(*[F.round(c(n), R).alias(n) if n in set(names) else c(n) for n in df.columns])


def stats_sql(source: str, keys: str = "", time: str | None = None) -> str:
    """Per-flow statistics by window functions, as plain SQL over `source`."""
    time = time or TSVAL
    lead = f"{keys}, " if keys else ""
    return f"""
      select {lead}stream_id as flow, avg(len) as flow_avg_len, coalesce(stddev_samp(len), 0) as flow_std_len,
        count(len) as flow_pkt_count,
        count(*) filter (where len > 1400) / (count(*) + 1e-6::double) as flow_large_pkt_ratio,
        avg(gap) as flow_avg_iat, coalesce(stddev_samp(gap), 0) as flow_std_iat, max(gap) as flow_max_iat,
        (max(t) - min(t)) / (count(*) + 1e-6::double) as flow_duration_per_pkt
      from (select *, coalesce(t - lag(t) over (partition by {lead}stream_id order by t), 0)::double as gap
            from (select {lead}stream_id, ('0x' || "ip.len")::bigint::double as len, {time} as t from {source}))
      group by {lead}stream_id"""


TSVAL = "coalesce(('0x' || substr(\"tcp.options.timestamp\", 5, 8))::bigint, 0)::double"
EPOCH = '"frame.time_epoch"::double'


def round_sql(source: str, keep: str, names) -> str:
    return f"select {keep}, " + ", ".join(f"round({n}::double, {R}) as {n}" for n in names) + f" from {source}"


@query("flow_stats", with_views(round_sql("s", "flow", STAT_NAMES), "packets", s=stats_sql("packets")))
def flow_stats(spark, sf_dir):
    stats = flows.flow_stats(packets(spark, sf_dir))
    return rounded(stats.withColumn("flow_pkt_count", F.col("flow_pkt_count").cast("double")), STAT_NAMES)


@query(
    "flow_stats_epoch",
    with_views(round_sql("s", "flow", STAT_NAMES), "packets", s=stats_sql("packets", time=EPOCH)),
)
def flow_stats_epoch(spark, sf_dir):
    stats = flows.flow_stats(packets(spark, sf_dir), time_columns=["frame.time_epoch"])
    return rounded(stats.withColumn("flow_pkt_count", F.col("flow_pkt_count").cast("double")), STAT_NAMES)


def endpoints_sql() -> str:
    return """select packet_id, '06' || '|' ||
      least("ip.src" || ':' || "tcp.srcport", "ip.dst" || ':' || "tcp.dstport") || '|' ||
      greatest("ip.src" || ':' || "tcp.srcport", "ip.dst" || ':' || "tcp.dstport") as stream_key from packets"""


@query("stream_key", with_views(endpoints_sql(), "packets"))
def stream_key(spark, sf_dir):
    df = packets(spark, sf_dir)
    return df.select("packet_id", flows.stream_key(df).alias("stream_key"))


@query(
    "stream_id",
    with_views(
        "select k.packet_id, dense_rank() over (order by f.first) as stream_id "
        "from k join (select stream_key, min(packet_id) as first from k group by 1) f using (stream_key)",
        "packets",
        k=endpoints_sql(),
    ),
)
def stream_id(spark, sf_dir):
    df = packets(spark, sf_dir).drop("stream_id")
    return flows.add_stream_id(df, "packet_id").select("packet_id", F.col("stream_id").cast("long"))


SEGMENTS = """case when packet_id % 7 = 0 then concat('#', packet_id - 3, '(100), #', packet_id, '(20), #',
 packet_id + 2) when packet_id % 11 = 0 then concat('#', packet_id - 1, ' #', packet_id - 4) end"""


@query(
    "segment_numbers",
    with_views(
        f"select packet_id, coalesce(array_to_string(regexp_extract_all({SEGMENTS}, '#(\\d+)', 1), ','), '') "
        "as numbers from packets",
        "packets",
    ),
)
def segment_numbers(spark, sf_dir):
    from flowloom.functions.scalars import segment_numbers as numbers

    found = F.coalesce(numbers(F.expr(SEGMENTS)).cast("array<string>"), F.array().cast("array<string>"))
    return packets(spark, sf_dir).select("packet_id", F.array_join(found, ",").alias("numbers"))


@query(
    "reassembly",
    with_views(
        """select coalesce(p.packet_id, a.m) as frame_num, p.label,
          case when p.packet_id is not null then coalesce(b.numbers, '') else a.numbers end as reassembled
        from packets p full outer join
          (select m, arg_max(numbers, packet_id) as numbers from members group by m) a on p.packet_id = a.m
        left join (select m, arg_max(numbers, packet_id) as numbers from members where packet_id >= m group by m) b
          on p.packet_id = b.m""",
        "packets",
        l=f"select packet_id, regexp_extract_all({SEGMENTS}, '#(\\d+)', 1) as parts from packets",
        members="select packet_id, array_to_string(parts, ',') as numbers, unnest(parts)::bigint as m from l "
        "where parts is not null",
    ),
)
def reassembly(spark, sf_dir):
    joined = flows.reassembly(packets(spark, sf_dir).select("packet_id", "label"), "packet_id", F.expr(SEGMENTS))
    return joined.select(
        "frame_num", "label", F.array_join(F.col("reassembled").cast("array<string>"), ",").alias("reassembled")
    )


# -- flow features on packets -----------------------------------------------------------------------------------

SPLIT_CTE = f"select *, {SPLIT} as split from packets"


def with_split(spark, sf_dir):
    return packets(spark, sf_dir).withColumn("split", F.expr(SPLIT))


def features_sql(join: str, defaults: dict[str, str], source: str, default_source: str, names=STAT_NAMES) -> str:
    picked = ", ".join(f"round(coalesce(s.{n}, {defaults[n]})::double, {R}) as {n}" for n in names)
    return f"select p.packet_id, p.split, {picked} from p left join {source} s on {join} {default_source}"


def feature_query(mode, names=STAT_NAMES):
    def run(spark, sf_dir):
        df = with_split(spark, sf_dir).select(
            "packet_id", "split", "stream_id", c("ip.len"), c("tcp.options.timestamp")
        )
        out = flows.flow_features(df, mode, "packet_id")
        return rounded(out.select("packet_id", "split", *names), names)

    return run


MIXED = {n: f"d.{n}" for n in STAT_NAMES}
MIXED_DEFAULTS = "select split, " + ", ".join(
    f"{'avg' if 'count' in n or 'ratio' in n else 'median'}({n}) as {n}" for n in STAT_NAMES
) + " from s group by split"
OPEN_DEFAULTS = "select " + ", ".join(
    (f"floor(avg({n}))" if "count" in n else f"avg({n})") + f" as {n}" for n in STAT_NAMES
) + " from s"
CLOSED = list(flows.CLOSED_WORLD_FEATURES)

query(
    "flow_features_per_split",
    with_views(
        features_sql("s.flow = p.stream_id and s.split = p.split", MIXED, "s", "left join d on d.split = p.split"),
        "packets", p=SPLIT_CTE, s=stats_sql("p", "split"), d=MIXED_DEFAULTS,
    ),
)(feature_query("per_split"))
query(
    "flow_features_open_world",
    with_views(
        features_sql("s.flow = p.stream_id", MIXED, "s", "cross join d"),
        "packets", p=SPLIT_CTE, t="select * from p where split = 'train'", s=stats_sql("t"), d=OPEN_DEFAULTS,
    ),
)(feature_query("open_world"))
query(
    "flow_features_closed_world",
    with_views(
        features_sql(
            "s.flow = p.stream_id and s.split = p.split", {n: "0" for n in CLOSED}, "s", "", CLOSED
        ),
        "packets", p=SPLIT_CTE, s=stats_sql("p", "split"),
    ),
)(feature_query("closed_world", CLOSED))
query(
    "flow_features_source",
    with_views(
        features_sql("s.flow = p.stream_id", {n: "0" for n in STAT_NAMES}, "s", ""),
        "packets", p=SPLIT_CTE, s=stats_sql("p"),
    ),
)(feature_query("source"))


@query(
    "flow_defaults",
    with_views(
        round_sql("d", "split", STAT_NAMES), "packets", p=SPLIT_CTE, s=stats_sql("p", "split"), d=MIXED_DEFAULTS
    ),
)
def flow_defaults(spark, sf_dir):
    stats = flows.flow_stats(with_split(spark, sf_dir), keys=["split"])
    defaults = flows.default_values(stats, "mixed", ["split"])
    renamed = defaults.select("split", *[F.col(f"{n}_default").alias(n) for n in STAT_NAMES])
    return rounded(renamed, STAT_NAMES)


@query(
    "flow_direction",
    with_views(
        f"""select packet_id, case when "ip.src" = first_value("ip.src") over w
           and "ip.dst" = first_value("ip.dst") over w then 1.0::double else -1.0::double end as flow_dir_sign,
           round(coalesce(t - lag(t) over w, 0)::double, {R}) as flow_iat_local
        from (select *, {TSVAL} as t from packets) window w as (partition by stream_id order by t, packet_id)""",
        "packets",
    ),
)
def flow_direction(spark, sf_dir):
    out = flows.direction_and_gap(packets(spark, sf_dir), "packet_id")
    return out.select("packet_id", "flow_dir_sign", F.round("flow_iat_local", R).alias("flow_iat_local"))


@query(
    "flow_direction_per_split",
    with_views(
        f"""select packet_id, split, case when "ip.src" = first_value("ip.src") over w
           and "ip.dst" = first_value("ip.dst") over w then 1.0::double else -1.0::double end as flow_dir_sign,
           round(coalesce(t - lag(t) over w, 0)::double, {R}) as flow_iat_local
        from (select *, {TSVAL} as t from p) window w as (partition by split, stream_id order by t, packet_id)""",
        "packets",
        p=SPLIT_CTE,
    ),
)
def flow_direction_per_split(spark, sf_dir):
    out = flows.direction_and_gap(with_split(spark, sf_dir), "packet_id", keys=["split"])
    return out.select("packet_id", "split", "flow_dir_sign", F.round("flow_iat_local", R).alias("flow_iat_local"))


MESSY = "case packet_id % 7 when 0 then 'abc' when 1 then 'NaN' when 2 then 'Infinity' when 3 then null " \
        "else concat(cast(packet_id as {0}), '.5') end"


@query(
    "clean_features",
    with_views(
        "select packet_id, case when packet_id % 7 < 4 then 0 else (packet_id || '.5')::double end::double "
        "as flow_avg_len, case when packet_id % 7 < 4 then 0 else packet_id end::integer as flow_pkt_count "
        "from packets",
        "packets",
    ),
)
def clean_features(spark, sf_dir):
    messy = F.expr(MESSY.format("string"))
    df = packets(spark, sf_dir).select("packet_id", messy.alias("flow_avg_len"), messy.alias("flow_pkt_count"))
    cleaned = flows.clean_features(df, ["flow_avg_len", "flow_pkt_count"])
    return cleaned.withColumn("flow_avg_len", F.col("flow_avg_len").cast("double"))


# -- packets of a flow ------------------------------------------------------------------------------------------


@query(
    "cap_packets",
    with_views(
        "select packet_id, stream_id from packets "
        "qualify row_number() over (partition by stream_id order by md5('42|' || packet_id)) <= 10",
        "packets",
    ),
)
def cap_packets(spark, sf_dir):
    return flows.cap_packets(packets(spark, sf_dir).select("packet_id", "stream_id"), 10, 42, "packet_id")


@query(
    "first_n_per_flow",
    with_views(
        "select packet_id, stream_id, label from packets "
        "qualify row_number() over (partition by stream_id order by packet_id) <= 8",
        "packets",
    ),
)
def first_n_per_flow(spark, sf_dir):
    return flows.first_n(packets(spark, sf_dir).select("packet_id", "stream_id", "label"), 8, "packet_id")


@query(
    "flow_batches",
    with_views(
        "select packet_id, k.stream_id, (r - 1) // 4 as batch_id from k join (select stream_id, "
        "row_number() over (order by min(packet_id)) as r, count(*) over () as n from k group by 1) "
        "using (stream_id) where (r - 1) // 4 < n // 4",
        "packets",
        k="select packet_id, stream_id from packets "
        "qualify row_number() over (partition by stream_id order by packet_id) <= 16",
    ),
)
def flow_batches(spark, sf_dir):
    df = packets(spark, sf_dir).select("packet_id", "stream_id")
    return flows.flow_batches(df, 16, 4, "packet_id", drop_last=True)


@query(
    "flow_batches_shuffled",
    with_views(
        "select packet_id, k.stream_id, (r - 1) // 4 as batch_id from k join (select stream_id, "
        "row_number() over (order by md5('42|' || stream_id)) as r from k group by 1) using (stream_id)",
        "packets",
        k="select packet_id, stream_id from packets "
        "qualify row_number() over (partition by stream_id order by packet_id) <= 16",
    ),
)
def flow_batches_shuffled(spark, sf_dir):
    df = packets(spark, sf_dir).select("packet_id", "stream_id")
    return flows.flow_batches(df, 16, 4, "packet_id", seed=42)


@query(
    "sampling_summary",
    with_views(
        f"""select label, count(distinct stream_id) as flows, count(*) as packets,
          round(count(distinct stream_id) / (select count(distinct stream_id) from packets)::double, {R}) as flow_ratio,
          round(count(*) / (select count(*) from packets)::double, {R}) as packet_ratio from packets group by label""",
        "packets",
    ),
)
def sampling_summary(spark, sf_dir):
    return rounded(flows.sampling_summary(packets(spark, sf_dir)), ["flow_ratio", "packet_ratio"])

"""Queries for projections, schema alignment, ingest rules and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import columns, encode
from flowloom.scale import c
from flowloom.sources import pdml
from flowloom.sources.tables import label_from_path as path_label
from registry.core import query
from registry.fixtures import FIELDS, SPLIT, packets, table, with_views

COUNTED = ["packet_id", *FIELDS]


def label_names(df) -> list[str]:
    """The labels that occur, one row each."""
    return [row["label"] for row in df.select("label").distinct().orderBy("label").collect()]


@query(
    "label_from_path",
    """with p as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages),
       n as (select *, split_part(path, '/', -1) as name from p)
    select page_id,
      split_part(case when contains(name, '.') then regexp_replace(name, '\\.[^.]*$', '') else name end, '_', 1)
        as by_stem,
      split_part(rtrim(substr(path, 1, length(path) - length(name)), '/'), '/', -1) as by_folder from n""",
)
def label_from_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return pages.select(
        "page_id", path_label(F.col("path")).alias("by_stem"), path_label(F.col("path"), "/captures").alias("by_folder")
    )


@query(
    "non_null_counts",
    with_views(
        " union all ".join(
            f"select '{n}' as field, count(case when cast(\"{n}\" as varchar) not in ('', 'nan', 'NaN') then 1 end) "
            "as n_non_null from packets"
            for n in COUNTED
        ),
        "packets",
    ),
)
def non_null_counts(spark, sf_dir):
    return columns.non_null_counts(packets(spark, sf_dir), COUNTED)


@query(
    "drop_all_null_columns",
    with_views(
        "select packet_id, \"ip.len\", \"tcp.options.mss_val\" from packets",
        "packets",
    ),
)
def drop_all_null_columns(spark, sf_dir):
    df = packets(spark, sf_dir).select(
        "packet_id", c("ip.len"), c("tcp.options.mss_val"), F.lit("nan").alias("ip.empty"), F.lit("").alias("ip.blank")
    )
    return columns.drop_all_null_columns(df)


@query(
    "pad_nulls",
    with_views(
        "select packet_id, " + ", ".join(f"coalesce(\"{n}\", 'ffff') as \"{n}\"" for n in FIELDS) + " from packets",
        "packets",
    ),
)
def pad_nulls(spark, sf_dir):
    return columns.pad_nulls(packets(spark, sf_dir).select("packet_id", *[c(n) for n in FIELDS]))


ALIGNED = ["packet_id", "ip.len", "tcp.options.mss_val", "ip.unknown", "tls.unknown"]


@query(
    "align_schema",
    with_views(
        "select packet_id, \"ip.len\", \"tcp.options.mss_val\", '0' as \"ip.unknown\", '0' as \"tls.unknown\" "
        "from packets",
        "packets",
    ),
)
def align_schema(spark, sf_dir):
    return columns.align_schema(packets(spark, sf_dir), ALIGNED, "0")


@query(
    "consolidate",
    with_views(
        "select row_number() over (order by label, packet_id) as frame_num, label, "
        + ", ".join(f'"{n}"' for n in FIELDS)
        + " from packets",
        "packets",
    ),
)
def consolidate(spark, sf_dir):
    df = packets(spark, sf_dir)
    sources = {f"{name}_1": df.filter(F.col("label") == name).drop("label") for name in label_names(df)}
    return columns.consolidate(sources, "packet_id")


_TLS = [n for n in FIELDS if n.startswith("tls.record")]


@query(
    "union_by_name",
    with_views(
        "select packet_id, label, \"ip.len\", "
        + ", ".join(f"case when label = 'click' then \"{n}\" end as \"{n}\"" for n in _TLS)
        + ", case when label = 'view' then \"ip.ttl\" end as \"ip.ttl\" from packets",
        "packets",
    ),
)
def union_by_name(spark, sf_dir):
    df = packets(spark, sf_dir)
    extra = {"click": _TLS, "view": ["ip.ttl"]}
    return columns.merge_by_label(
        {
            name: df.filter(F.col("label") == name).select(
                "packet_id", c("ip.len"), *[c(n) for n in extra.get(name, [])]
            )
            for name in label_names(df)
        }
    )


@query("row_count", with_views("select label, count(*) as n from packets group by label", "packets"))
def row_count(spark, sf_dir):
    """Rows per label, each counted by the operator; there are a handful of labels."""
    df = packets(spark, sf_dir)
    counts = [(name, columns.row_count(df, F.col("label") == name)) for name in label_names(df)]
    return spark.createDataFrame(counts, "label string, n bigint")


@query(
    "keep_prefix_columns",
    with_views(
        "select packet_id, " + ", ".join(f'"{n}"' for n in FIELDS if n.startswith(("tcp.", "tls."))) + " from packets",
        "packets",
    ),
)
def keep_prefix_columns(spark, sf_dir):
    return columns.keep_prefix_columns(packets(spark, sf_dir), ["tcp.", "tls."], ["packet_id"])


@query(
    "tcp_only",
    with_views(
        "select packet_id, label from packets where packet_id % 3 <> 0 and ("
        + " or ".join(f'"{n}" is not null' for n in FIELDS if n.startswith("tcp."))
        + ")",
        "packets",
    ),
)
def tcp_only(spark, sf_dir):
    """Every third packet loses its tcp fields first, so that some packets go."""
    df = packets(spark, sf_dir)
    bare = F.col("packet_id") % 3 == 0
    cut = [F.when(~bare, c(n)).alias(n) if n.startswith("tcp.") else c(n) for n in df.columns]
    return columns.tcp_only(df.select(*cut)).select("packet_id", "label")


_UPPER = [n for n in FIELDS if n.startswith(columns.UPPER_PREFIXES)]
_UPPER_SQL = " or ".join(f"coalesce(\"{n}\" not in ('0', ''), false)" for n in _UPPER)


@query("upper_layer_filter", with_views(f"select packet_id, label from packets where {_UPPER_SQL}", "packets"))
def upper_layer_filter(spark, sf_dir):
    return columns.upper_layer_filter(packets(spark, sf_dir)).select("packet_id", "label")


@query(
    "upper_layer_summary",
    with_views(
        f"""select label, split, count(*) as total, count(*) filter (where {_UPPER_SQL}) as kept,
          count(*) filter (where not ({_UPPER_SQL})) as removed,
          round(count(*) filter (where not ({_UPPER_SQL})) / count(*)::double, 6) as removed_ratio
        from p group by 1, 2""",
        "packets",
        p=f"select *, {SPLIT} as split from packets",
    ),
)
def upper_layer_summary(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("split", F.expr(SPLIT))
    return columns.upper_layer_summary(df, ["label", "split"]).withColumn(
        "removed_ratio", F.round("removed_ratio", 6)
    )


def _split_figures(split: str) -> str:
    inside, kept = f"split = '{split}'", f"({_UPPER_SQL})"
    total, gone = f"count(*) filter (where {inside})", f"count(*) filter (where {inside} and not {kept})"
    return (
        f"nullif({total}, 0) as {split}_total, case when {total} > 0 then count(*) filter (where {inside} and {kept}) end "
        f"as {split}_kept, case when {total} > 0 then {gone} end as {split}_removed, "
        f"case when {total} > 0 then round({gone} / {total}::double, 6) end as {split}_removed_ratio"
    )


@query(
    "upper_layer_table",
    with_views(
        "select label, " + ", ".join(map(_split_figures, ("train", "validation", "test"))) + " from p group by 1",
        "packets",
        p=f"select *, {SPLIT} as split from packets",
    ),
)
def upper_layer_table(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("split", F.expr(SPLIT))
    summary = columns.upper_layer_summary(df, ["label", "split"]).withColumn("removed_ratio", F.round("removed_ratio", 6))
    return columns.upper_layer_table(summary, ("train", "validation", "test"), dataset="label")


@query(
    "drop_unseen_labels",
    with_views(
        "select p.packet_id, m.label_id from packets p join (select label, row_number() over (order by min(packet_id)) "
        "- 1 as label_id from packets where label <> 'signup' group by 1) m using (label)",
        "packets",
    ),
)
def drop_unseen_labels(spark, sf_dir):
    df = packets(spark, sf_dir).drop("label_id")
    labels = encode.label_map(df.filter(F.col("label") != "signup"), "packet_id")
    return columns.drop_unseen_labels(encode.apply_label_map(df, labels)).select("packet_id", "label_id")


# -- dissection rules -------------------------------------------------------------------------------------------

_KEY = "(event_id + pos)"
_NAME = "concat('ip.f', case when pos = 7 then 2 else pos end)"
_VALUE = (
    f"case when {_KEY} % 4 = 0 then null when {_KEY} % 13 = 0 then repeat('a', 70) "
    f"else concat('v', {_KEY} % 100) end"
)
_SHOW = f"case when {_KEY} % 8 = 0 then null else concat('s', {_KEY} % 10) end"
_HIDE = f"case when {_KEY} % 9 = 0 then 'yes' when {_KEY} % 9 = 1 then 'no' end"
_RAW = f"select event_id as packet_id, pos, {_NAME} as name, {_VALUE} as value, {_SHOW} as \"show\", {_HIDE} as hide"
_RAW_DUCK = f"{_RAW} from (select event_id, unnest(range(0, 8)) as pos from events)"
_KEPT_DUCK = """select packet_id, name, arg_max(coalesce(value, "show"), pos) as value from raw
  where hide is distinct from 'yes' and length(coalesce(value, "show")) < 64 group by 1, 2"""


def raw_fields(spark, sf_dir):
    expanded = table(spark, sf_dir, "events").select(
        "event_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos")
    )
    return expanded.select(
        F.col("event_id").alias("packet_id"),
        "pos",
        F.expr(_NAME).alias("name"),
        F.expr(_VALUE).alias("value"),
        F.expr(_SHOW).alias("show"),
        F.expr(_HIDE).alias("hide"),
    )


@query("field_filter", f"with raw as ({_RAW_DUCK}) {_KEPT_DUCK}")
def field_filter(spark, sf_dir):
    return pdml.field_filter(raw_fields(spark, sf_dir))


@query(
    "pdml_fields",
    f"""with raw as ({_RAW_DUCK}) {_KEPT_DUCK}
    union all select event_id, 'num', event_id::varchar from events
    union all select event_id, 'frame.number', event_id::varchar from events""",
)
def pdml_fields(spark, sf_dir):
    """The same fields written as dissection XML, nested in a protocol, and parsed back."""

    def attribute(name: str, value) -> object:
        return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise(F.lit(""))

    def element(pos):
        key = F.col("event_id") + pos
        name = F.concat(F.lit("ip.f"), F.when(pos == 7, F.lit(2)).otherwise(pos).cast("string"))
        value = F.when(key % 4 == 0, F.lit(None).cast("string")).when(
            key % 13 == 0, F.repeat(F.lit("a"), F.lit(70))
        ).otherwise(F.concat(F.lit("v"), (key % 100).cast("string")))
        show = F.when(key % 8 != 0, F.concat(F.lit("s"), (key % 10).cast("string")))
        hide = F.when(key % 9 == 0, F.lit("yes")).when(key % 9 == 1, F.lit("no"))
        return F.concat(
            F.lit("<field"),
            attribute("name", name),
            attribute("value", value),
            attribute("show", show),
            attribute("hide", hide),
            F.lit("/>"),
        )

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), element), "")
    number = F.col("event_id").cast("string")
    xml = F.concat(
        F.lit('<packet><proto name="geninfo"><field name="num" show="'), number, F.lit('"/></proto><proto name="ip">'),
        body, F.lit("</proto>"),
    )
    parsed = pdml.parse_packets(table(spark, sf_dir, "events").select(xml.alias("value")))
    exploded = parsed.select(
        F.col("fields").getItem("frame.number").cast("bigint").alias("packet_id"), F.explode("fields")
    )
    return exploded.select("packet_id", F.col("key").alias("name"), "value")

"""Projections, schema alignment and row filters over wide packet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.scale import c, quoted, rank_by_number, small_side
from flowloom.session import stored

META = ("index", "label", "label_id")
LAYER_PREFIXES = ("eth.", "ip.", "tcp.", "tls.")
UPPER_PREFIXES = ("tcp.options.", "tls.")
NULL_TEXTS = ("", "nan", "NaN")


def fields_of(df: DataFrame, prefixes: Sequence[str] = LAYER_PREFIXES) -> list[str]:
    """Column names that start with one of the layer prefixes, in table order."""
    return [name for name in df.columns if name.startswith(tuple(prefixes))]


def real_value(name: str) -> Column:
    """The column with the texts that stand for null turned into null."""
    return F.when(~c(name).cast("string").isin(*NULL_TEXTS), c(name))


def wide_to_long(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn a one-row (or small) wide table into rows (name, value)."""
    pairs = [F.struct(F.lit(col).alias(name), c(col).alias(value)) for col in columns]
    others = [c(col) for col in df.columns if col not in set(columns)]
    return df.select(*others, F.explode(F.array(*pairs)).alias("_pair")).select(*others, "_pair.*")


def non_null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, n_non_null) in one pass: one counter per column, no row multiplication."""
    names = list(columns or df.columns)
    counted = df.agg(*[F.count(real_value(name)).alias(name) for name in names])
    return wide_to_long(counted, names, "field", "n_non_null")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Null-like texts become null; columns without any value are dropped."""
    counts = df.agg(*[F.count(real_value(name)).alias(name) for name in df.columns]).first()
    return df.select(*[real_value(name).alias(name) for i, name in enumerate(df.columns) if counts[i] > 0])


def pad_nulls(df: DataFrame, value: str = "ffff", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of text columns with one constant."""
    targets = set(columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"])
    return df.select(
        *[(F.coalesce(c(n), F.lit(value)).alias(n) if n in targets else c(n)) for n in df.columns]
    )


def keep_prefix_columns(df: DataFrame, prefixes: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    keep = set(fields_of(df, prefixes)) | set(always)
    return df.select(*[c(name) for name in df.columns if name in keep])


def align_schema(df: DataFrame, schema: Sequence[str], fill: str | None = None) -> DataFrame:
    """Exactly the given columns in the given order; missing ones hold `fill` (or null)."""
    present = set(df.columns)
    return df.select(
        *[c(name) if name in present else F.lit(fill).cast("string").alias(name) for name in schema]
    )


def lock_schema(frames: Sequence[DataFrame], lock: str = "union", fill: str | None = None) -> list[DataFrame]:
    """Align several tables: to all columns (`union`, sorted) or to those of the first one (`first` / `train`)."""
    if lock == "union":
        schema = sorted({name for frame in frames for name in frame.columns})
    elif lock in ("first", "train"):
        schema = list(frames[0].columns)
    else:
        raise ValueError(f"unknown schema lock: {lock}")
    return [align_schema(frame, schema, fill) for frame in frames]


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables whose columns differ; absent fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_by_label(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate one table per label and add the label."""
    return union_by_name([frames[name].withColumn("label", F.lit(name)) for name in sorted(frames)])


def consolidate(frames: Mapping[str, DataFrame], order_by: str, prefixes: Sequence[str] = LAYER_PREFIXES) -> DataFrame:
    """One table of all sources: layer fields only, sorted schema, `frame_num` 1..N in (source, order) order.

    The label of a source is its name up to the first underscore. `order_by` is a numeric row order inside a source.
    """
    parts = []
    for position, name in enumerate(sorted(frames)):
        frame = frames[name]
        kept = [c(col) for col in fields_of(frame, prefixes)]
        parts.append(
            frame.select(
                F.lit(name.split("_")[0]).alias("label"),
                F.lit(position).alias("_source"),
                c(order_by).cast("long").alias("_order"),
                *kept,
            )
        )
    merged = union_by_name(parts)
    # ranges and offsets come from a stored table of the row orders alone
    orders = stored(merged.select("_source", "_order"), "orders")
    ranked = rank_by_number(merged, "_order", within=["_source"], name="_rank", keys=orders)
    sizes = orders.groupBy("_source").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_source", F.col("_size")).toArrow().to_pylist()
    sizes_by_source = {row["_source"]: row["_size"] for row in starts}
    shift, total = F.lit(0), 0
    for position in range(len(parts)):
        shift = F.when(F.col("_source") == position, F.lit(total)).otherwise(shift)
        total += sizes_by_source.get(position, 0)
    schema = sorted({name for name in merged.columns} - {"label", "_source", "_order"})
    return ranked.select((F.col("_rank") + shift).alias("frame_num"), "label", *[c(name) for name in schema])


def has_upper_layer(df: DataFrame, prefixes: Sequence[str] = UPPER_PREFIXES) -> Column:
    """True for rows with any TCP option or TLS field that is set and neither '0' nor empty."""
    names = fields_of(df, prefixes)
    if not names:
        raise ValueError("the table has no tcp.options.* or tls.* column")
    return reduce(lambda a, b: a | b, [F.coalesce(~c(n).isin("0", ""), F.lit(False)) for n in names])


def upper_layer_filter(df: DataFrame) -> DataFrame:
    return df.filter(has_upper_layer(df))


def upper_layer_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, kept rows, removed rows and their share per dataset and split."""
    kept = F.count_if(has_upper_layer(df))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("total"), kept.alias("kept"))
        .withColumn("removed", F.col("total") - F.col("kept"))
        .withColumn("removed_ratio", F.coalesce(F.try_divide("removed", "total"), F.lit(0.0)))
    )


def upper_layer_table(
    summary: DataFrame, splits: Sequence[str], dataset: str = "dataset", split: str = "split"
) -> DataFrame:
    """One row per data set with total, kept, removed and removed_ratio of every split; a split it lacks is null."""
    figures = ("total", "kept", "removed", "removed_ratio")
    cells = [F.max(F.when(c(split) == s, c(f))).alias(f"{s}_{f}") for s in splits for f in figures]
    return summary.groupBy(dataset).agg(*cells)


def drop_repeated_headers(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(c(label) != label)


def valid_flow_rows(df: DataFrame, label: str = "label", flow: str = "stream_id") -> DataFrame:
    return df.dropna(subset=[quoted(label), quoted(flow)])


def tcp_only(df: DataFrame) -> DataFrame:
    """Packets that carry any `tcp.*` field."""
    return df.filter(F.coalesce(*[c(name) for name in fields_of(df, ("tcp.",))]).isNotNull())


def row_count(df: DataFrame, condition: Column | None = None) -> int:
    return (df if condition is None else df.filter(condition)).count()


def field_whitelist(observed: DataFrame, catalog: DataFrame, prefixes: Sequence[str] = LAYER_PREFIXES) -> DataFrame:
    """(field, status): catalog fields of the table are `kept`, other protocol-like ones `excluded`."""
    known = catalog.select("field", F.lit(True).alias("_known"))
    like = reduce(lambda a, b: a | b, [F.col("field").startswith(p) for p in prefixes])
    return (
        observed.select("field")
        .join(small_side(known), "field", "left")
        .filter(F.col("_known").isNotNull() | like)
        .select("field", F.when(F.col("_known"), F.lit("kept")).otherwise(F.lit("excluded")).alias("status"))
    )


def drop_unseen_labels(df: DataFrame, label_id: str = "label_id") -> DataFrame:
    return df.filter(c(label_id) >= 0)

"""Packet scores to flow scores.

Scores are an array column of `num_classes` logits. Softmax-weighted means use magnitude bins: a row of score z goes to
bin floor(z / 64) and is scaled by that bin's upper end, so partial sums never overflow and need neither the group's
maximum first nor a window. A group then has a handful of bins, merged by their distance to the highest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import softmax
from flowloom.scale import c, top_per_group

BIN = 64.0
LOGITS = "logits"


def _elements(column: str, size: int) -> list[Column]:
    return [F.get(c(column), F.lit(i)).cast("double") for i in range(size)]


def as_long(df: DataFrame, column: str, keys: Sequence[str], index: str = "class_id", value: str = "value"):
    """(keys, index, value) rows of an array column."""
    return df.select(*[c(k) for k in keys], F.posexplode(column).alias(index, value))


def flow_mean(df: DataFrame, num_classes: int, flow: str = "stream_id", probabilities: bool = False) -> DataFrame:
    """(flow, scores): mean logits, or mean softmax, per class."""
    source = df.select(c(flow), (softmax(F.col(LOGITS)) if probabilities else F.col(LOGITS)).alias(LOGITS))
    means = [F.avg(x) for x in _elements(LOGITS, num_classes)]
    return source.groupBy(flow).agg(F.array(*means).alias("scores"))


def weighted_mean(df: DataFrame, keys: Sequence[str], score: Column, vector: str, size: int, out: str) -> DataFrame:
    """Per group, the vectors' mean weighted by softmax(score)."""
    z = score.cast("double")
    scaled = df.select(*[c(k) for k in keys], c(vector), z.alias("_z")).withColumn("_bin", F.floor(F.col("_z") / BIN))
    weight = F.exp(F.col("_z") - (F.col("_bin") + 1) * BIN)
    parts = (
        scaled.withColumn("_w", weight)
        .groupBy(*keys, "_bin")
        .agg(F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * x).alias(f"_x{i}") for i, x in enumerate(
            _elements(vector, size))])
    )
    top = F.max("_bin").over(Window.partitionBy(*keys))
    merged = parts.withColumn("_f", F.exp((F.col("_bin") - top) * BIN))
    norm = F.sum(F.col("_w") * F.col("_f"))
    return merged.groupBy(*keys).agg(
        F.array(*[F.sum(F.col(f"_x{i}") * F.col("_f")) / norm for i in range(size)]).alias(out)
    )


def flow_soft_weighted(df: DataFrame, num_classes: int, temp: float = 1.0, flow: str = "stream_id") -> DataFrame:
    """Logits weighted by softmax(max logit / temp) inside the flow."""
    confidence = F.array_max(LOGITS).cast("double") / F.lit(max(float(temp), 1e-4))
    return weighted_mean(df, [flow], confidence, LOGITS, num_classes, "scores")


def flow_weighted(df: DataFrame, num_classes: int, score: str, flow: str = "stream_id") -> DataFrame:
    """Logits weighted by softmax of a given score column inside the flow."""
    return weighted_mean(df, [flow], c(score), LOGITS, num_classes, "scores")


def flow_topk_mean(df: DataFrame, num_classes: int, k: int, row_id: str, flow: str = "stream_id") -> DataFrame:
    """Mean logits of the k packets with the highest maximum logit, ties by row id."""
    order = [F.desc(F.array_max(LOGITS)), c(row_id).asc()]
    return flow_mean(top_per_group(df, [flow], order, max(1, k), c(row_id)), num_classes, flow)


def flow_logsumexp(df: DataFrame, flow: str = "stream_id") -> DataFrame:
    """(flow, scores): logsumexp of each class minus ln(packets)."""
    long = as_long(df, LOGITS, [flow]).withColumn("_bin", F.floor(F.col("value") / BIN))
    parts = long.groupBy(flow, "class_id", "_bin").agg(
        F.sum(F.exp(F.col("value") - (F.col("_bin") + 1) * BIN)).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    top = F.max("_bin").over(Window.partitionBy(flow, "class_id"))
    merged = parts.withColumn("_top", top)
    total = F.sum(F.col("_s") * F.exp((F.col("_bin") - F.col("_top")) * BIN))
    value = (F.max("_top") + 1) * BIN + F.log(total) - F.log(F.sum("_n").cast("double"))
    per_class = merged.groupBy(flow, "class_id").agg(value.alias("value"))
    return per_class.groupBy(flow).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class_id", "value"))), lambda s: s["value"]).alias("scores")
    )


def pool_vectors(
    df: DataFrame,
    group: str,
    vector: str,
    size: int,
    mode: str = "mean",
    score: Column | None = None,
    tau: float = 1.0,
    first_n: int = 0,
    order_by: str | None = None,
) -> DataFrame:
    """(group, pooled): elementwise max, mean or softmax-weighted mean, optionally of the first n rows."""
    rows = df
    if first_n > 0:
        if order_by is None:
            raise ValueError("first_n needs order_by")
        rows = top_per_group(df, [group], [c(order_by)], first_n, c(order_by))
    if mode == "attn":
        if score is None:
            raise ValueError("attn pooling needs a score")
        return weighted_mean(rows, [group], score / F.lit(float(tau)), vector, size, "pooled")
    if mode not in ("max", "mean"):
        raise ValueError(f"unknown pooling mode: {mode}")
    combine = F.max if mode == "max" else F.avg
    return rows.groupBy(group).agg(F.array(*[combine(x) for x in _elements(vector, size)]).alias("pooled"))


def flow_label(df: DataFrame, label: str = "label_id", flow: str = "stream_id", rule: str = "majority") -> DataFrame:
    """(flow, label_id, is_mixed): majority label (ties to the smallest id), or the smallest label for `smallest`."""
    counted = df.groupBy(c(flow).alias(flow), c(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    if rule == "majority":
        chosen = F.max_by("_label", F.struct("_n", -F.col("_label")))
    elif rule == "smallest":
        chosen = F.min("_label")
    else:
        raise ValueError(f"unknown rule: {rule}")
    return counted.groupBy(flow).agg(chosen.alias(label), (F.count(F.lit(1)) > 1).alias("is_mixed"))

"""Confusion matrices and the metrics computed from them.

A confusion matrix is the long table (actual, predicted, n), optionally with leading key columns such as a level or a
noise setting. It has at most classes squared rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import argmax, max_probability
from flowloom.operators.scores import LOGITS, flow_label, flow_mean
from flowloom.scale import c, small_side

EPS = 1e-8


def confusion_matrix(
    df: DataFrame, num_classes: int, actual: str = "actual", predicted: str = "predicted", keys: Sequence[str] = (),
    extra_columns: int = 0, weight: Column | None = None,
) -> DataFrame:
    """Counts for every (actual, predicted) cell, zeros included; ids out of range are skipped.

    `extra_columns` allows that many more predicted ids than classes (an "unknown" column). `weight` counts a row more
    than once, for tables that are already grouped.
    """
    width = num_classes + extra_columns
    inside = F.col("actual").between(0, num_classes - 1) & F.col("predicted").between(0, width - 1)
    counted = (
        df.groupBy(*keys, c(actual).cast("long").alias("actual"), c(predicted).cast("long").alias("predicted"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
        .filter(inside)
    )
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(num_classes - 1).cast("long")),
            lambda a: F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")),
                lambda p: F.struct(a.alias("actual"), p.alias("predicted"), F.lit(0).cast("long").alias("n")),
            ),
        )
    )
    owners = counted.select(*keys).distinct() if keys else df.sparkSession.range(1)
    zeros = owners.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*")
    return counted.unionByName(zeros).groupBy(*keys, "actual", "predicted").agg(F.sum("n").alias("n"))


def per_class_metrics(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(class_id, support, predicted, tp, precision, recall, f1) for every class of the matrix."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("actual").alias("class_id"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")
        ),
        F.struct(
            F.col("predicted").alias("class_id"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")
        ),
    )
    counted = (
        cm.select(*keys, F.explode(sides).alias("s"))
        .select(*keys, "s.*")
        .groupBy(*keys, "class_id")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )
    precision = F.col("tp") / (F.col("predicted") + F.lit(EPS))
    recall = F.col("tp") / (F.col("support") + F.lit(EPS))
    return (
        counted.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(EPS)),
        )
    )


def classification_metrics(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro, support-weighted and overall metrics, one row per key."""
    classes = per_class_metrics(cm, keys)
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), total), F.lit(0.0))

    return classes.groupBy(*keys).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.coalesce(F.try_divide(F.sum("tp"), total), F.lit(0.0)).alias("accuracy"),
        total.alias("samples"),
    )


def flow_predictions(
    df: DataFrame, num_classes: int, use_prob_mean: bool = True, flow: str = "stream_id", label: str = "label_id"
) -> DataFrame:
    """(flow, actual, predicted, is_mixed): majority label against the argmax of mean scores."""
    scores = flow_mean(df, num_classes, flow, probabilities=use_prob_mean)
    labels = flow_label(df, label, flow)
    return scores.join(labels, flow).select(
        c(flow), c(label).alias("actual"), argmax(F.col("scores")).alias("predicted"), "is_mixed"
    )


def packet_predictions(df: DataFrame, label: str = "label_id") -> DataFrame:
    return df.select(c(label).alias("actual"), argmax(F.col(LOGITS)).alias("predicted"))


def dual_level_metrics(df: DataFrame, num_classes: int, flow: str = "stream_id", label: str = "label_id") -> DataFrame:
    """`classification_metrics` for the packet and the flow level (mean logits)."""
    packets = packet_predictions(df, label).withColumn("level", F.lit("packet"))
    flows = flow_predictions(df, num_classes, False, flow, label).withColumn("level", F.lit("flow"))
    both = packets.select("level", "actual", "predicted").union(flows.select("level", "actual", "predicted"))
    return classification_metrics(confusion_matrix(both, num_classes, keys=["level"]), ["level"])


def flow_eval(
    df: DataFrame, num_classes: int, use_prob_mean: bool = True, flow: str = "stream_id", label: str = "label_id"
) -> DataFrame:
    """Flow-level metrics with the number of flows and of flows with mixed labels."""
    predicted = flow_predictions(df, num_classes, use_prob_mean, flow, label)
    # at most two rows per cell of the matrix: everything below reads this table
    cells = small_side(predicted.groupBy("actual", "predicted", "is_mixed").agg(F.count(F.lit(1)).alias("m")))
    counts = cells.agg(
        F.struct(
            F.coalesce(F.sum("m"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(F.col("is_mixed"), F.col("m"))), F.lit(0)).alias("mixed"),
        ).alias("c")
    ).scalar()
    metrics = classification_metrics(confusion_matrix(cells, num_classes, weight=F.col("m")))
    return metrics.select(
        "*", counts["all"].cast("long").alias("num_flows"), counts["mixed"].cast("long").alias("inconsistent_flows")
    )


def reject_predictions(df: DataFrame, num_classes: int, threshold: float = 0.9, label: str = "label_id") -> DataFrame:
    """(actual, predicted): the class id `num_classes` stands for a rejected prediction."""
    unsure = max_probability(F.col(LOGITS)) < threshold
    # softmax keeps the order, so the best class is that of the logits
    return df.select(
        c(label).alias("actual"),
        F.when(unsure, F.lit(num_classes)).otherwise(argmax(F.col(LOGITS))).alias("predicted"),
    )


def reject_eval(df: DataFrame, num_classes: int, threshold: float = 0.9, label: str = "label_id") -> DataFrame:
    """Metrics over accepted rows and the rejection rate; classes without an accepted row do not count."""
    cells = small_side(
        reject_predictions(df, num_classes, threshold, label)
        .groupBy(F.col("actual").cast("long").alias("actual"), F.col("predicted").cast("long").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    accepted = cells.filter(F.col("predicted") < num_classes)
    rejected = F.sum(F.when(F.col("predicted") == num_classes, F.col("n")).otherwise(F.lit(0)))
    rate = cells.agg(F.coalesce(F.try_divide(rejected, F.sum("n")), F.lit(0.0)).alias("r")).scalar()
    metrics = classification_metrics(accepted)
    names = [n for n in metrics.columns if n != "samples"]
    return metrics.select(
        *[F.coalesce(F.col(n), F.lit(0.0)).alias(f"accepted_{n}") for n in names], rate.alias("rejection_rate")
    )


def cm_percent(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row percentages (an empty row divides by 1) and each row's place by support."""
    row_sum = F.sum("n").over(Window.partitionBy(*keys, "actual"))
    with_sum = cm.withColumn("row_sum", row_sum)
    place = F.dense_rank().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("row_sum"), "actual"))
    percent = F.col("n") * 100.0 / F.greatest(F.col("row_sum"), F.lit(1))
    return with_sum.withColumn("row_place", place.cast("long")).select(
        *keys, "actual", "predicted", percent.alias("percent"), "row_place"
    )


def cm_table(cm: DataFrame, labels: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The matrix as a table: a row per class (`actual_id`, `actual_label`), a column per predicted label.

    `labels` are the class names by id; `extra` names predicted ids beyond the classes ("unknown"). Cells without a row
    are 0.
    """
    names = [*labels, *extra]
    if len({n.lower() for n in [*names, "actual_id", "actual_label"]}) < len(names) + 2:
        raise ValueError("labels must differ from each other and from actual_id and actual_label, also in lower case")
    wide = cm.groupBy("actual").pivot("predicted", list(range(len(names)))).agg(F.sum("n"))
    counts = [F.coalesce(c(str(i)), F.lit(0)).cast("long").alias(name) for i, name in enumerate(names)]
    label = F.array(*[F.lit(x) for x in labels])[F.col("actual")]
    return wide.select(F.col("actual").alias("actual_id"), label.alias("actual_label"), *counts)


def cm_subset(cms: DataFrame, labels: Sequence, matrix: str = "matrix_id") -> DataFrame:
    """Rows and columns of the wanted labels that every matrix has, with their positions in list order.

    `cms` holds several matrices told apart by `matrix`.
    """
    wanted = F.array(*[F.lit(x) for x in labels])
    n_matrices = cms.select(matrix).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    as_row = cms.select(matrix, F.col("actual").alias("label")).distinct()
    as_column = cms.select(matrix, F.col("predicted").alias("label")).distinct()
    common = (
        as_row.join(as_column, [matrix, "label"])
        .filter(F.array_contains(wanted, F.col("label")))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("_m"))
        .filter(F.col("_m") == n_matrices)
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.array_position(wanted, F.col("label")))
    placed = common.select("label", (F.row_number().over(order) - 1).cast("long").alias("place"))
    rows = placed.select(F.col("label").alias("actual"), F.col("place").alias("row_place"))
    columns = placed.select(F.col("label").alias("predicted"), F.col("place").alias("column_place"))
    return cms.join(rows, "actual").join(columns, "predicted")


def robustness_table(df: DataFrame, num_classes: int, level: str = "noise_level", label: str = "label_id") -> DataFrame:
    """Packet-level metrics per noise level; `df` holds the scores of every level."""
    predicted = df.select(c(level), c(label).alias("actual"), argmax(F.col(LOGITS)).alias("predicted"))
    cm = confusion_matrix(predicted, num_classes, keys=[level])
    return classification_metrics(cm, [level]).select(
        level, "accuracy", "f1_macro", "precision_macro", "recall_macro"
    )

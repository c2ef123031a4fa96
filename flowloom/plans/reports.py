"""Report jobs: upper-layer data sets, field blocks, confusion matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import blocks as block_ops
from flowloom.operators import metrics
from flowloom.operators.columns import union_by_name, upper_layer_filter, upper_layer_table
from flowloom.plans.preprocess import SPLITS
from flowloom.scale import c
from flowloom.sources.tables import write_table


def upper_layer_datasets(
    spark: SparkSession,
    datasets: Mapping[str, str],
    out_root: str,
    summary_path: str,
    splits: Sequence[str] = SPLITS,
    force: bool = False,
) -> DataFrame:
    """The packets with upper-layer fields of every data set, and a summary of what went.

    `datasets` maps names to split tables (partitioned by split). The kept packets of `splits` go to `out_root/<name>`,
    partitioned alike; a finished one is skipped. The summary has one row per data set with total, kept, removed and
    removed_ratio per split, null for a split that it lacks. A data set without upper-layer columns is an error, as in
    the filter.
    """
    counts = []
    for name, path in datasets.items():
        rows = spark.read.parquet(path).filter(c("split").isin(*splits))
        out = f"{out_root}/{name}"
        write_table(upper_layer_filter(rows), out, ["split"], force=force)
        # the split is a folder, so the counts read no column; with the schema given, nothing kept reads as no rows
        kept = spark.read.schema(rows.schema).parquet(out).filter(c("split").isin(*splits))
        sides = [rows.select("split", F.lit(1).alias("n"), F.lit(0).alias("k")), kept.select("split", F.lit(0), F.lit(1))]
        counts.append(sides[0].union(sides[1]).withColumn("dataset", F.lit(name)))
    found = union_by_name(counts).groupBy("dataset", "split").agg(F.sum("n").alias("total"), F.sum("k").alias("kept"))
    removed = F.col("total") - F.col("kept")
    summary = found.withColumns({"removed": removed, "removed_ratio": F.coalesce(F.try_divide(removed, "total"), F.lit(0.0))})
    names = spark.createDataFrame([(name,) for name in datasets], "dataset string")
    write_table(names.join(upper_layer_table(summary, splits), "dataset", "left"), summary_path, force=True)
    return spark.read.parquet(summary_path)


def block_report(rows: DataFrame, block_table: DataFrame, fields: Sequence[str], out: str, force: bool = False) -> None:
    """Two tables about field blocks: `out/labels` (rows per label and block) and `out/fields` (which block has which field).

    `rows` are packets with `label` and `block_id`. Each row of a table is one line of cells in the order of the blocks,
    which `out/blocks` (block_id, n_rows, fields) lists.
    """
    order = block_table.select("block_id", "n_rows", F.concat_ws(",", "schema").alias("fields"))
    write_table(order, f"{out}/blocks", force=force)
    # a block without a labelled row keeps its place
    empty = block_table.select(F.lit(None).cast("string").alias("label"), "block_id", F.lit(0).cast("long").alias("n"))
    labelled = block_ops.label_block_counts(rows.filter(c("label").isNotNull())).unionByName(empty)
    labels = block_ops.matrix_lines(labelled, "label", "block_id", "n").filter(c("label").isNotNull())
    write_table(labels, f"{out}/labels", force=force)
    present = block_ops.feature_block_matrix(block_table, fields)
    write_table(block_ops.matrix_lines(present, "field", "block_id", "present"), f"{out}/fields", force=force)


def confusion_report(
    df: DataFrame, labels: Sequence[str], out: str, flow: str | None = "stream_id", label: str = "label_id", force: bool = False
) -> None:
    """Labelled confusion matrices of packets (`out/packet`) and, with a flow column, of flows (`out/flow`) as CSV."""
    packets = metrics.confusion_matrix(metrics.packet_predictions(df, label), len(labels))
    tables = {"packet": packets}
    if flow is not None:
        tables["flow"] = metrics.confusion_matrix(metrics.flow_predictions(df, len(labels), flow=flow, label=label), len(labels))
    for name, cm in tables.items():
        # at most one row per class
        write_table(metrics.cm_table(cm, labels).coalesce(1).sortWithinPartitions("actual_id"), f"{out}/{name}", force=force, fmt="csv")

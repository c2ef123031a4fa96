"""Preprocessing: dissected packets of one data set to split tables with flow ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import blocks as block_ops
from flowloom.operators.columns import fields_of
from flowloom.operators.flows import add_stream_id
from flowloom.operators.sampling import split_flows_by_length
from flowloom.scale import c
from flowloom.session import durable
from flowloom.sources.pdml import field_names, packets_of, read_outcomes, rejects_of, widen
from flowloom.sources.tables import consolidate_csvs, discover_files, is_finished, label_from_path, write_table

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class PreprocessOptions:
    test: float = 0.1
    validation: float = 0.1
    length_bins: int = 4
    seed: int = 42
    force: bool = False
    merge_threshold: float = 0.8
    min_block_rows: int = 1000
    top_k: int = 3
    min_class_rows: int = 3000


def dissection_to_packets(spark: SparkSession, root: str, out: str, force: bool = False) -> DataFrame:
    """Dissection files below `root` to one labelled wide table at `out`, skipped if it is already there.

    The label is a file's folder, or its name up to the first underscore for files directly in `root`.
    Packets that can't be used go to the table `out`_rejects (path, raw, reason).
    """
    if force or not is_finished(spark, out):
        outcomes = durable(read_outcomes(spark, root + "/*"))
        write_table(rejects_of(outcomes), out.rstrip("/") + "_rejects", force=True)
        labelled = packets_of(outcomes).withColumn("label", label_from_path(F.col("path"), root))
        names = [n for n in field_names(labelled) if n != "label"]
        write_table(widen(labelled, names, keep=["label"]), out, ["label"], force=True)
    return spark.read.parquet(out)


def consolidate_folder(spark: SparkSession, folder: str, out: str, force: bool = False) -> DataFrame:
    """All CSV files of a folder to one numbered table at `out`, skipped if it is already there."""
    if force or not is_finished(spark, out):
        # one row per file
        paths = [row["path"] for row in discover_files(spark, folder, suffix=".csv").select("path").collect()]
        write_table(consolidate_csvs(spark, paths), out, force=True)
    return spark.read.parquet(out)


def split_tables(packets: DataFrame, out: str, options: PreprocessOptions) -> DataFrame:
    """Flow ids and flow-wise splits, written partitioned by split."""
    spark = packets.sparkSession
    if options.force or not is_finished(spark, out):
        flows = add_stream_id(packets, "frame_num")
        split = split_flows_by_length(
            flows,
            "frame_num",
            bins=options.length_bins,
            test=options.test,
            validation=options.validation,
            seed=options.seed,
        )
        write_table(split, out, ["split"], force=True)
    return spark.read.parquet(out)


def chief_table(packets: DataFrame, out: str, options: PreprocessOptions, fields: Sequence[str] | None = None) -> bool:
    """Blocks by field presence, merged by tree similarity, then the largest ones topped up with rare classes."""
    names = [n for n in (fields or fields_of(packets)) if n != "tcp.reassembled_segments"]
    table = block_ops.block_table(packets, names)
    plan = block_ops.merge_plan_tree(table, options.min_block_rows, options.merge_threshold)
    merged = block_ops.apply_merge(block_ops.assign_blocks(packets, names, table), names, table, plan)
    # merged experts are the blocks of the next step
    regrouped = merged.drop("block_id", "fingerprint")
    experts = block_ops.block_table(regrouped, names)
    rows = block_ops.assign_blocks(regrouped, names, experts)
    chief = block_ops.augment_top_k(rows, names, experts, options.top_k, options.min_class_rows)
    return write_table(chief.drop("fingerprint"), out, force=options.force)


def run_preprocessing(
    spark: SparkSession,
    datasets: Mapping[str, str],
    out_root: str,
    options: PreprocessOptions | None = None,
    with_chief: bool = False,
) -> dict[str, str]:
    """Consolidate, number flows and split every data set; a failing one is reported and the others go on.

    `datasets` maps names to folders of per-label CSV files. Returns the outcome per data set.
    """
    options = options or PreprocessOptions()
    outcome = {}
    for name, folder in datasets.items():
        base = f"{out_root}/{name}"
        try:
            packets = consolidate_folder(spark, folder, f"{base}/consolidated", options.force)
            split_tables(packets, f"{base}/split", options)
            if with_chief:
                chief_table(packets, f"{base}/chief", options)
            outcome[name] = "done"
        except Exception as error:  # noqa: BLE001 - one bad data set must not stop the others
            outcome[name] = f"failed: {error}"
    return outcome


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a written split table (partition pruned)."""
    return spark.read.parquet(path).filter(c("split") == split)

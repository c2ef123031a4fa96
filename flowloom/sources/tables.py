"""File discovery, CSV packet tables, table writers and vocabularies."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.columns import LAYER_PREFIXES, align_schema, fields_of, union_by_name
from flowloom.scale import c, small_side
from flowloom.session import durable

SPLIT_ROWS = 2_000_000
SPLIT_BYTES = 512 << 20


def discover_files(spark: SparkSession, root: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, base_name) of the files below `root` whose name has the prefix and suffix; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{prefix}*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )
    name = F.substring_index("path", "/", -1)
    return listed.select("path", F.substr(name, F.lit(1), F.length(name) - len(suffix)).alias("base_name"))


def label_from_path(path: Column, root: str | None = None) -> Column:
    """Parent directory if the file is nested below `root`, else the file stem up to its first underscore.

    Without a root always the stem.
    """
    name = F.substring_index(path, "/", -1)
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    by_stem = F.substring_index(stem, "_", 1)
    if root is None:
        return by_stem
    folder = F.regexp_replace(F.substr(path, F.lit(1), F.length(path) - F.length(name)), "/+$", "")
    return F.when(folder.endswith(root.rstrip("/")), by_stem).otherwise(F.substring_index(folder, "/", -1))


def column_names(header: str) -> tuple[str, ...]:
    """Column names of a CSV header line; an empty one is `_c<place>`, a repeated one gets its place as suffix."""
    names = next(csv.reader([header]), [])
    seen = Counter(name.lower() for name in names)
    named = enumerate(names)
    return tuple(f"_c{k}" if not name else f"{name}{k}" if seen[name.lower()] > 1 else name for k, name in named)


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, header) of every file that isn't empty, in one job; no more of a file is read than its beginning.

    A session of its own gives every file one task, which takes the first line and ends.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    session.conf.set("spark.sql.files.openCostInBytes", str(1 << 50))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = session.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("header"))
    return lines.mapInArrow(first, "path string, header string")


def read_packets_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files of one header as all-string columns."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    if columns is None:
        header = first_lines(spark, listed[:1]).first()
        columns = column_names(header["header"]) if header else ()
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return spark.read.csv(listed, header=True, schema=schema)


def frames_by_header(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """One all-string table per distinct header; files with equal headers are read together.

    The headers are read by tasks, and grouped before they reach the driver: one row per distinct header, with its files.
    """
    if not paths:
        return []
    lines = first_lines(spark, paths).groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    by_names: dict[tuple[str, ...], list[str]] = {}
    for row in lines.collect():
        by_names.setdefault(column_names(row["header"]), []).extend(row["paths"])
    ordered = sorted(by_names.items(), key=lambda item: min(item[1]))
    return [read_packets_csv(spark, sorted(group), names) for names, group in ordered]


def merge_csvs(spark: SparkSession, root: str, prefix: str = "", suffix: str = ".csv") -> DataFrame:
    """All matching CSV files below `root` by column name; absent columns are null."""
    found = discover_files(spark, root, prefix, suffix).select("path").collect()  # one row per file
    return union_by_name(frames_by_header(spark, [row["path"] for row in found]))


def merge_label_folders(spark: SparkSession, root: str, add_label: bool = False) -> dict[str, DataFrame]:
    """One table per folder directly below `root`, of all CSV files in it, optionally with the folder as label."""
    found = discover_files(spark, root, suffix=".csv").select("path").collect()
    by_folder: dict[str, list[str]] = {}
    for row in found:
        inside = row["path"].split(root.rstrip("/") + "/", 1)[-1]
        if inside.count("/") == 1:
            by_folder.setdefault(inside.split("/")[0], []).append(row["path"])
    merged = {name: union_by_name(frames_by_header(spark, paths)) for name, paths in sorted(by_folder.items())}
    if not add_label:
        return merged
    return {name: frame.withColumn("label", F.lit(name)) for name, frame in merged.items()}


def consolidate_csvs(spark: SparkSession, paths: Sequence[str], prefixes: Sequence[str] = LAYER_PREFIXES) -> DataFrame:
    """All CSV files as one table: label from the file name, layer fields, sorted schema, `frame_num` 1..N by path.

    Row numbers come from the row counts per file split, summed up over
    the splits in path and offset order; rows themselves are never sorted. The files are read once, into the checkpoint
    folder: counting and numbering see the same splits, whatever the settings are when the result is evaluated. A row
    whose split has no count is an error, never dropped.
    """
    parts = []
    for frame in frames_by_header(spark, paths):
        parts.append(
            frame.select(
                F.col("_metadata.file_path").alias("_path"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_row"),
                *[c(name) for name in fields_of(frame, prefixes)],
            )
        )
    merged = durable(union_by_name(parts))
    splits = merged.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    schema = sorted(set(merged.columns) - {"_path", "_start", "_row"})
    # one row per file split (100 TB in 128 MB splits are 800 000 rows)
    numbered = merged.join(small_side(offsets, SPLIT_ROWS, SPLIT_BYTES), ["_path", "_start"], "left")
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return numbered.select(
        F.coalesce(number, F.raise_error(F.lit("a file split was not counted")).cast("long")).alias("frame_num"),
        label_from_path(F.col("_path")).alias("label"),
        *[c(name) for name in schema],
    )


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def is_finished(spark: SparkSession, path: str) -> bool:
    """Has a table been completely written to `path`?"""
    filesystem, folder = _filesystem(spark, path)
    return filesystem.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), force: bool = False, fmt: str = "parquet"
) -> bool:
    """Write `df` unless a finished table is already there; returns whether it was written."""
    if not force and is_finished(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return True


def append_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet") -> None:
    """Append rows aligned to the table's columns, '0' where a column is missing."""
    writer = align_schema(df, columns, "0").write.mode("append").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("field", "value", "id").write.mode("overwrite").json(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("field string, value string, id bigint").json(path)

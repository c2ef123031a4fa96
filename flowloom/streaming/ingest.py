"""Dissection files to a growing packet table, file by file as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.session import stored
from flowloom.sources.pdml import MAX_VALUE_LENGTH, PACKET_END, packets_of, parse_outcomes, rejects_of, widen
from flowloom.sources.tables import label_from_path

#: Column that tells which micro-batch wrote a row; a folder per batch, so that a batch is written anew as a whole.
BATCH = "batch"


def ingest_pdml(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    names: Sequence[str],
    files_per_batch: int = 100,
    max_len: int = MAX_VALUE_LENGTH,
    rejects_dir: str | None = None,
) -> StreamingQuery:
    """Append every new file below `in_dir` to the Parquet table `out_dir`; files already taken are not read again.

    The schema is locked to `names`: fields outside it are dropped, absent ones are null. Packets that can't be used go to
    `rejects_dir` (by default `<out_dir>_rejects`) as (path, raw, reason), from the same parse. Both tables have a folder per
    batch, which a repeated batch replaces, so nothing is written twice after a restart. The checkpoint records which files
    are done, so a restarted job goes on where it stopped. The query ends when all files present are read.
    """
    rejected = rejects_dir or f"{out_dir.rstrip('/')}_rejects"
    text = (
        spark.readStream.option("lineSep", PACKET_END)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .text(in_dir)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )

    def replace(rows: DataFrame, folder: str, batch: int, by: Sequence[str]) -> None:
        writer = rows.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BATCH, *by).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        # the parse is written once; both tables read it
        outcomes = stored(parse_outcomes(batch, max_len=max_len), "outcomes")
        packets = packets_of(outcomes).withColumn("label", label_from_path(F.col("path"), in_dir))
        replace(widen(packets, names, keep=["label"]), out_dir, number, ["label"])
        replace(rejects_of(outcomes), rejected, number, [])

    stream = text.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()

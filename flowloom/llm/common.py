"""Helpers the operators of this package share: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import ensure_checkpoint_dir

#: Bytes that a table may take in memory to be broadcast, and what a row takes there besides its values.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new path below the checkpoint folder, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str = "table") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: later steps survive a lost executor."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet, whatever the case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def narrow(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A narrow table with a broadcast hint if it was measured to be small; else as it is, for a shuffled join.

    Give a saved or cheap table, since it is counted here, texts by their length. No more rows are looked at than fit.
    """
    flat = {"string", "binary"}
    texts = [f.name for f in df.schema if f.dataType.typeName() in flat]
    fixed = ROW_BYTES + 16 * len(df.columns)
    rows = limit // fixed
    length = sum((F.coalesce(F.octet_length(F.col(quoted(n))), F.lit(0)) for n in texts), F.lit(0)).cast("long")
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("b")).first()
    return F.broadcast(df) if found["n"] * fixed + (found["b"] or 0) <= limit else df


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of `column` stay about `max_bytes`; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(batch.column(at).fill_null("").value_lengths() if hasattr(batch.column(at), "value_lengths") else _lengths(batch.column(at)))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes, "right"))
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position per node of a graph of n nodes."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b); component is the smallest node that can be reached.

    Alternating star contraction: in turn, every node's larger neighbours, then its smaller ones, are tied to its
    smallest neighbour, until nothing changes. The rounds grow with the logarithm of the longest path. Joins, not
    windows, carry the minimum, so that adaptive execution can split the star of a hub. Each round is a table in the
    shared folder. Loops (a = b) and null ends add nothing.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter(F.col("a") != F.col("b"))
    now = saved(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def stars(links: DataFrame, larger: bool) -> DataFrame:
        # links hold a > b
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        tied = both.join(low, "a")
        if larger:
            tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("low").alias("y"))
        else:
            tied = tied.select(F.col("b").alias("x"), F.col("low").alias("y")).unionByName(
                low.select(F.col("a").alias("x"), F.col("low").alias("y"))
            )
        return tied.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    if seen[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        now = saved(stars(stars(now, True), False), "edges")
        then = mark(now)
        if then == seen:
            break
        seen = then
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def summed(counts: DataFrame, size: int, key: str = "slot", value: str = "n") -> np.ndarray:
    """Sums of `value` per slot as a dense vector; at most `size` rows reach the driver."""
    rows = counts.groupBy(key).agg(F.sum(value).alias(value)).toArrow()
    out = np.zeros(size, dtype=np.float64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def returns_memory(function: Callable) -> Callable:
    """Hand what a fit has freed back to the system: the C library keeps it, and the driver lives on long after."""

    @wraps(function)
    def run(*args, **named):
        try:
            return function(*args, **named)
        finally:
            trim_memory()

    return run


def trim_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark drops shuffle files and broadcasts of finished steps only after that.

    Many small steps in a row otherwise let the driver's heap grow to its limit between collections. Plans that Python's own
    garbage still holds go first.
    """
    trim_memory()
    spark.sparkContext._jvm.System.gc()


def clashing(columns: Sequence[str]) -> list[str]:
    return [name for name in columns if columns.count(name) > 1]

"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The log weight of a document is the log ratio of its probability under two bags of hashed words and word pairs: one of
all documents marked as good, one of all documents. Adding a Gumbel number hashed from the id and keeping the largest
sums draws without replacement in proportion to the weights.

Edge cases: null, empty and wordless texts have log weight 0. Without target documents all weights are 0, and the draw
is uniform. Rows with equal sums at the cut (repeated rows) are all selected. Null ids share one Gumbel number. An
empty table gives an empty one. Columns named like an output are replaced by it; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import fresh, narrow, quoted, saved, slices, summed, unit_hash
from flowloom.llm.text import PRIME, mix, normalized, segment_sums, words_of

SLOTS = 1 << 14
SMOOTHING = 1.0
#: Share of the documents that the sample holds.
SHARE = 0.5
SEED = 4
EXACT_ROWS = 10_000


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of words, slots of pairs, word offsets); a text's last pair is -1."""
    words, offsets = words_of(column)
    pairs = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        pairs[:-1] = (mix(words[:-1] * np.uint64(PRIME) + words[1:]) % np.uint64(SLOTS)).astype(np.int64)
        lasts = offsets[1:] - 1
        pairs[lasts[lasts >= 0]] = -1
    return (words % np.uint64(SLOTS)).astype(np.int64), pairs, offsets


def log_ratio(docs: DataFrame, target: DataFrame, text: str, key: str) -> np.ndarray:
    """Per slot, the log of target over raw probability; `target` holds the keys of all target documents."""
    ids = narrow(saved(target.select(F.col(quoted(key)).alias("k")).filter("k is not null").distinct().withColumn("good", F.lit(True)), "target"))
    rows = docs.select(F.col(quoted(key)).alias("k"), normalized(F.col(quoted(text))).alias("t")).join(ids, "k", "left").select("t", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2 * SLOTS, dtype=np.int64)
        for part in slices(batches, "t"):
            words, pairs, offsets = grams_of(part.column(0))
            good = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(offsets))
            for slot in (words, pairs):
                found[:SLOTS] += np.bincount(slot[slot >= 0], minlength=SLOTS)
                found[SLOTS:] += np.bincount(slot[(slot >= 0) & good], minlength=SLOTS)
        slot = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(found[slot])], names=["slot", "n"])

    counts = summed(rows.mapInArrow(count, "slot long, n long"), 2 * SLOTS).reshape(2, SLOTS)
    if not counts[1].sum():
        return np.zeros(SLOTS)
    raw, wanted = (np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * SLOTS)) for c in counts)
    return wanted - raw


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, found by narrowing histograms; at most `EXACT_ROWS` values reach the driver."""
    rows = keys.select(F.col(quoted(column)).alias("x")).filter("x is not null")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n or k < 1:
        return None
    need = min(k, n)
    while n > EXACT_ROWS and low < high:
        width = (high - low) / 1024
        slot = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(1023))
        inside = rows.filter((F.col("x") >= low) & (F.col("x") <= high))
        found = inside.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("s")).collect()
        for r in found:
            if need <= r["n"]:
                break
            need -= r["n"]
        if r["n"] == n:
            break
        low, high, n = r["low"], r["high"], r["n"]
    counted = rows.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").count().orderBy(F.desc("x")).limit(EXACT_ROWS).collect()
    for r in counted:
        if need <= r["count"]:
            return float(r["x"])
        need -= r["count"]
    raise RuntimeError("more equal buckets than can be told apart")


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """`docs` without the text, with `log_weight`, `gumbel_key` and `selected` (about `share` of the rows)."""
    ratio = log_ratio(docs, target, text, key)
    added = ("log_weight", "gumbel_key", "selected")
    kept = [c for c in docs.columns if c.lower() not in added and c != text]
    words, noise = fresh(docs, "words"), fresh(docs, "noise")
    u = F.greatest(unit_hash(seed, F.col(quoted(key))), F.lit(2.0**-49))
    rows = docs.select(*[F.col(quoted(c)) for c in kept], (-F.log(-F.log(u))).alias(noise), normalized(F.col(quoted(text))).alias(words))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, words):
            one, two, offsets = grams_of(part.column(part.num_columns - 1))
            both = ratio[one] + np.where(two >= 0, ratio[two], 0.0)
            weight = segment_sums(both, offsets)
            key_ = weight + part.column(part.num_columns - 2).to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(weight), pa.array(key_)], names=[*kept, "log_weight", "gumbel_key"])

    weighed = saved(rows.mapInArrow(weigh, schema), "weights")
    cut = kth_largest(weighed, "gumbel_key", round(share * weighed.count()))
    return weighed.withColumn("selected", F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut))

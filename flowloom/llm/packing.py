"""Documents packed into training sequences by vector best-fit.

A document is its token ids and a closing id. One longer than a sequence is cut; its first piece takes what doesn't fill
whole sequences, so that all others do. A sequence has room for so many tokens, so many documents and so much attention
cost (the sum of squared piece lengths). Pieces are placed by falling weighted size; each goes to the open sequence that
has room in every dimension and where the weighted norm of what stays free is least (or, by `rule`, whose free room has
the largest weighted dot product with the piece). Weights are the mean demands of the pieces, as shares of a capacity.

Pieces are dealt to shards of about `SHARD` by hash, so that every shard sees the same mix of lengths; only their
numbers and lengths are shuffled. Sequences that stay open are emptied and their pieces meet again in fewer shards, until
one shard is left or that stops helping: waste doesn't grow with the number of shards.

Edge cases: a null or empty text is its closing id alone. Null and repeated ids are documents of their own (each row is
one). An empty table gives an empty one. Extra columns are ignored. Ties go to the earlier row and the older sequence.
A piece that alone exceeds the attention cost is refused by an error, since no sequence could hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import narrow, quoted, saved, slices
from flowloom.llm.tokens import encoder

LENGTH = 2048
#: Pieces that one task packs, on average.
SHARD = 16_384
#: Free tokens, as a share of a sequence, above which a sequence's pieces are packed again.
SLACK = 1 / 256


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(row, key, piece, start, length, ids) of every text; ids are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for part in slices(batches, "t", 8 << 20, 16384):
            ids, offsets = own.encode(part.column(1))
            # the closing ids
            offsets = offsets + np.arange(len(offsets))
            whole = np.full(offsets[-1], end_id, dtype="<u4")
            closing = np.zeros(len(whole), dtype=bool)
            closing[offsets[1:] - 1] = True
            whole[~closing] = ids
            sizes = np.diff(offsets)
            many = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), many)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = (sizes - (many - 1) * length)[doc]
            start = np.where(number == 0, 0, first + (number - 1) * length)
            size = np.where(number == 0, first, length)
            begin = (offsets[:-1][doc] + start) * 4
            raw = whole.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(size),
                    pa.array([raw[a:b] for a, b in zip(begin, begin + size * 4, strict=True)], pa.binary()),
                ],
                names=["id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("t"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary")
    return found.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias(key), "piece", "start", "length", "ids")


def best_fit(lengths: np.ndarray, room: tuple[int, int, int], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) per piece, for pieces in the order given on ties; sequences are numbered from 0."""
    n = len(lengths)
    demand = np.stack([lengths, np.ones(n, np.int64), lengths * lengths], axis=1)
    capacity = np.array(room, dtype=np.int64)
    if n and (demand > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    share = demand / capacity
    weights = share.mean(axis=0) if n else np.ones(3)
    order = np.argsort(-(share @ weights), kind="stable")
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    free, number = np.empty((n, 3), np.int64), np.empty(n, np.int64)
    open_, made, least = 0, 0, int(lengths.min()) if n else 0
    for step, i in enumerate(order):
        if step % 512 == 511:
            # a sequence without room for the shortest piece is full
            stays = (free[:open_, 0] >= least) & (free[:open_, 1] > 0) & (free[:open_, 2] >= least * least)
            kept = int(stays.sum())
            free[:kept], number[:kept] = free[:open_][stays], number[:open_][stays]
            open_ = kept
        tokens, _, cost = demand[i]
        view = free[:open_]
        fits = np.flatnonzero((view[:, 0] >= tokens) & (view[:, 1] >= 1) & (view[:, 2] >= cost))
        if len(fits):
            rest = view[fits] / capacity
            if rule == "dot":
                at = fits[np.argmax(rest @ (weights * share[i]))]
            else:
                at = fits[np.argmin(np.square(rest - share[i]) @ weights)]
        else:
            at = open_
            free[at], number[at] = capacity, made
            open_, made = open_ + 1, made + 1
        sequence[i], offset[i] = number[at], capacity[0] - free[at, 0]
        free[at] -= demand[i]
    return sequence, offset


def _packed(items: DataFrame, shards: int, turn: int, room: tuple[int, int, int], rule: str) -> DataFrame:
    """(row, length, sequence_id, offset, free) of `items` (row, length), packed in `shards` groups."""

    def run(group: pa.Table) -> pa.Table:
        rows, lengths = group.column("row").to_numpy(), group.column("length").to_numpy()
        by_row = np.argsort(rows)
        rows, lengths = rows[by_row], lengths[by_row]
        sequence, offset = best_fit(lengths, room, rule)
        first = np.zeros(sequence.max() + 1, np.int64)
        first[sequence[offset == 0]] = rows[offset == 0]
        used = np.zeros(len(first), np.int64)
        np.add.at(used, sequence, lengths)
        return pa.table({"row": rows, "length": lengths, "sequence_id": first[sequence], "offset": offset, "free": room[0] - used[sequence]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(run, "row long, length long, sequence_id long, offset long, free long")


def places(items: DataFrame, room: tuple[int, int, int], rule: str = "norm") -> DataFrame:
    """(row, sequence_id, offset) of the pieces `items` (row, length); a sequence is named after its first piece."""
    items = items.select("row", "length")
    alone = items.filter(F.col("length") >= room[0]).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < room[0])
    count = rest.count()
    done, turn, shards = [alone], 0, -(-count // SHARD)
    packed = saved(_packed(rest, max(shards, 1), turn, room, rule), "packed")
    while shards > 1:
        slack = F.col("free") > int(room[0] * SLACK)
        left, sequences = packed.filter(slack).agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        fewer = -(-left // SHARD)
        if not left or fewer >= shards:
            break
        turn += 1
        again = saved(_packed(packed.filter(slack).select("row", "length"), fewer, turn, room, rule), "packed")
        if again.filter("offset = 0").count() >= sequences:
            break
        done.append(packed.filter(~slack).select("row", "sequence_id", "offset"))
        packed, shards = again, fewer
    for part in done:
        packed = packed.select("row", "sequence_id", "offset").unionByName(part)
    return packed.select("row", "sequence_id", "offset")


def pack(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, documents: int = LENGTH,
    attention: int = LENGTH * LENGTH, end_id: int = 0, rule: str = "norm",
) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset) of every piece.

    A sequence holds at most `length` tokens of `documents` documents, and squared piece lengths of at most `attention`.
    The defaults let the tokens decide. `vocabulary` is the path of a byte-level tokenizer file on every executor.
    """
    cut = saved(pieces(docs, vocabulary, text, key, length, end_id), "pieces")
    found = saved(places(cut, (length, documents, attention), rule), "places")
    return cut.join(narrow(found), "row").drop("row")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, length, documents, ids) of every sequence: its pieces' ids in order; at most `length` of them."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", F.col(quoted(key)).alias("id"), "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids))
    return parts.select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x.length).alias("length"),
        F.transform("p", lambda x: F.struct(x.id.alias(key), x.offset.alias("offset"), x.length.alias("length"))).alias("documents"),
        joined.alias("ids"),
    )

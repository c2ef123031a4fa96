"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on `PROJECTIONS` random directions. A window of half-width `WIDTH` around the query's
projection is cut so wide that a pair at the threshold collides in nearly every projection (the difference of two unit
vectors with cosine 0.98 has length 0.2, so its projections are normal with deviation 0.2). The sorted list of every
projection is cut into cells two half-widths wide, and a query's window covers at most two cells of a list. `TABLES`
groups of `LEADS` projections each deal the vectors out: a query meets the vectors of the cells that its windows cover
in all lists of a group, sorted by one more projection, along which its window is found by binary search. Of these,
pairs that collide in at least `COLLISIONS` of all projections are verified by cosine in double precision.

A pair is counted only in the first group in which its windows collide, so no list of pairs is needed: tasks return
sums per vector and a spanning forest of the links they found. Copies of a vector stand for themselves with a weight.
Cells with many vectors are cut into parts, and their queries too.

Recall: a pair at cosine 0.98 collides in one projection with probability 0.9973 (three deviations), in all lists of a
group and its sorting projection with at least 0.989, so at least one of the two groups has it with 0.9998; fewer than
`COLLISIONS` of 24 collisions have a probability below 1e-6. `LEADS` should grow with the logarithm of the table.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and null labels, link with nothing.
Vectors of different lengths don't link. Rows that repeat an id stand for one vector each and count as others. Rows
with a null id keep a row without links. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import connected_components, local_roots, narrow, quoted, saved

THRESHOLD = 0.98
PROJECTIONS, TABLES, LEADS = 24, 2, 3
WIDTH = 0.6
COLLISIONS = 20
#: Vectors of a cell, and queries of a cell, that one task compares.
PART = 4096
STEP = 1 << 20


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([22, size]).standard_normal((size, PROJECTIONS))


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a binary column of equal-length float64 vectors."""
    rows = np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def prepared(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) per row; label and v are null where the row can't link."""
    rows = vectors.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    return rows.select("id", F.when(good, F.col("label")).alias("label"), F.when(good, F.col("v")).alias("v"))


def placed(rows: DataFrame) -> DataFrame:
    """One row per (table, cell, role): owners in their own cell, queries in every cell their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = part.column(3).to_pylist()
                size = np.array([len(v) for v in raw])
                for n in np.unique(size):
                    own = np.flatnonzero(size == n)
                    rows_in = np.array([raw[i] for i in own], dtype=np.float64)
                    unit = rows_in / np.max(np.abs(rows_in), axis=1, keepdims=True)
                    p = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ directions(int(n))
                    packed = [x.tobytes() for x in unit]
                    where, table, cell, query = [], [], [], []
                    for t in range(TABLES):
                        lead = p[:, t * (LEADS + 1) : t * (LEADS + 1) + LEADS]
                        home = np.floor(lead / (2 * WIDTH)).astype(np.int64)
                        low = np.floor((lead - WIDTH) / (2 * WIDTH)).astype(np.int64)
                        where.append(np.arange(len(own)))
                        cell.append(home)
                        query.append(np.zeros(len(own), bool))
                        table.append(np.full(len(own), t))
                        for corner in range(1 << LEADS):
                            where.append(np.arange(len(own)))
                            cell.append(low + (corner >> np.arange(LEADS) & 1))
                            query.append(np.ones(len(own), bool))
                            table.append(np.full(len(own), t))
                    at, cells = np.concatenate(where), np.concatenate(cell)
                    take = pa.array(own[at])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(np.full(len(at), n), pa.int32()),
                            pa.array(np.concatenate(table), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()),
                            pa.array(np.concatenate(query)), pa.array([packed[i] for i in at], pa.binary()),
                        ],
                        names=["id", "label", "weight", "size", "table", "cell", "query", "v"],
                    )

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "weight", "v").mapInArrow(
        run, f"id long, label {label}, weight long, size int, table int, cell binary, query boolean, v binary"
    )


def compare(group: pa.Table) -> pa.Table:
    """(id, links) and (id, root) of the pairs in one part of a cell that this table is the first to see."""
    query = group.column("query").to_numpy()
    ids, weight = group.column("id").to_numpy(), group.column("weight").to_numpy()
    t = group.column("table")[0].as_py()
    unit = matrix(group.column("v").combine_chunks())
    p = unit @ directions(unit.shape[1])
    owners, queries = np.flatnonzero(~query), np.flatnonzero(query)
    along = t * (LEADS + 1) + LEADS
    owners = owners[np.argsort(p[owners, along], kind="stable")]
    line = p[owners, along]
    begin = np.searchsorted(line, p[queries, along] - WIDTH, "left")
    end = np.searchsorted(line, p[queries, along] + WIDTH, "right")
    widths, found = end - begin, []
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(np.cumsum(widths[at:]), STEP)) + at)
        n = widths[at:to]
        a = np.repeat(queries[at:to], n)
        b = owners[np.repeat(begin[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        keep = ids[a] < ids[b]
        a, b = a[keep], b[keep]
        count = np.zeros(len(a), dtype=np.int64)
        for j in range(PROJECTIONS):
            count += np.abs(p[a, j] - p[b, j]) <= WIDTH
            if j >= PROJECTIONS - COLLISIONS:
                good = count >= j + 1 - (PROJECTIONS - COLLISIONS)
                a, b, count = a[good], b[good], count[good]
        for earlier in range(t):
            span = slice(earlier * (LEADS + 1), (earlier + 1) * (LEADS + 1))
            new = ~(np.abs(p[a, span] - p[b, span]) <= WIDTH).all(axis=1)
            a, b = a[new], b[new]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= THRESHOLD
        found.append((a[near], b[near]))
        at = to
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (owners[:0], owners[:0])
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    nodes, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    roots = local_roots(len(nodes), at[: len(a)], at[len(a) :]) if len(nodes) else np.zeros(0, np.int64)
    total = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(total, np.searchsorted(nodes, ids[links > 0]), links[links > 0])
    return pa.table({"id": pa.array(nodes, pa.int64()), "links": pa.array(total), "root": pa.array(nodes[roots], pa.int64())})


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) per row: others linked directly, and the smallest id reachable by links."""
    rows = saved(prepared(vectors, key, vector, label), "vectors")
    copies = rows.filter(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = saved(copies.withColumn("node", F.xxhash64("label", "v")), "classes")
    deal = placed(classes.select(F.col("node").alias("id"), "label", "weight", "v"))
    cell = ["label", "size", "table", "cell"]
    counts = deal.groupBy(*cell).agg(F.sum((~F.col("query")).cast("long")).alias("owners"), F.sum(F.col("query").cast("long")).alias("queries"))
    parts = counts.filter("owners > 0 and queries > 0").select(
        *cell, F.ceil(F.col("owners") / PART).cast("int").alias("o"), F.ceil(F.col("queries") / PART).cast("int").alias("q")
    )
    mixed = F.xxhash64("id")
    spread = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda i: F.struct(i.alias("o"), F.pmod(mixed, F.col("q")).cast("int").alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda i: F.struct(F.pmod(mixed, F.col("o")).cast("int").alias("o"), i.alias("q")))
    )
    dealt = deal.join(narrow(saved(parts, "cells")), cell).withColumn("part", F.explode(spread))
    found = saved(dealt.groupBy(*cell, "part").applyInArrow(compare, "id long, links long, root long"), "links")
    sums = found.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    tied = classes.join(sums, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = saved(tied.select("label", "v", "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "tied")
    smallest = tied.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = tied.join(smallest, "component").select("label", "v", "n_links", "component_id")
    return rows.join(per_class, ["label", "v"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )

"""Embedding whitening by mixed-precision refinement of a distributed covariance's eigenvectors.

Components become integers floor(`SCALE` * c) + `SHIFT`, so that every sum over rows is exact, whatever the order of the
tasks. Count and sums per dimension are gathered first; products are then taken of rows centred at the rounded mean, and
what the rounding left over (less than one half) is taken out of the sums in whole numbers. The covariance is thus the
true one, rounded once.

Its eigenvectors are found in float32 and corrected by iterations of Ogita and Aishima, which consist of matrix products
in extended precision and converge quadratically. Eigenvalues that lie closer together than an iteration can tell apart
form a cluster; the covariance restricted to its vectors, less the cluster's mean eigenvalue, is solved on its own, which
spreads the cluster by its own scale, and the iterations go on.

Only sums and products of dimensions, never rows, reach the driver. The whitened rows are multiplied once more to state
how far their own covariance is from the identity.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are entries beyond 2^30
after scaling, which no integer sum could hold. Vectors whose length isn't the most frequent one (of equally frequent
ones the larger) are dropped as well. Components without variance (at most 1e-13 of the whole) can't be scaled to one and
are left out; so is everything for a table of equal rows. Null and repeated ids are rows like others. An empty table gives
an empty one. Extra columns are ignored. Equal eigenvalues have no order of their own; any basis of theirs may come.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import quoted, saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries are integers below this bound; a task's sums are given out before they could pass 2^62.
BOUND = 1 << 30
#: Eigenvalues below this share of the trace count as none.
NO_VARIANCE = 1e-13
STEP = 4096


def prepared(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the rows that take part; x is an array of longs."""
    rows = vectors.select(F.col(quoted(key)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale + abs(shift) < BOUND))
    whole = F.transform("v", lambda c: F.floor(c * scale) + shift)
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & usable).select("id", whole.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Count and exact sum per dimension."""
    found = rows.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    by_dimension = {r.j: (int(r.s), r.n) for r in found}
    return (by_dimension[0][1] if by_dimension else 0), [by_dimension[j][0] for j in range(size)] if by_dimension else []


def products(rows: DataFrame, size: int, centre: list[int]) -> np.ndarray:
    """Exact sums of products of all pairs of dimensions, of rows centred at whole numbers, as Python integers."""
    middle = np.array(centre, dtype=np.int64)
    upper = np.triu_indices(size)
    slot = pa.array((upper[0] * size + upper[1]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((size, size), np.int64), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([slot, pa.array(total[upper])], names=["slot", "p"])

        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                y = _matrix(batch.column(0).slice(start, STEP), size) - middle
                largest = int(np.abs(y).max()) + 1
                bound = largest * largest * len(y)
                if held + bound > 1 << 62:
                    yield out()
                    total, held = np.zeros((size, size), np.int64), 0
                if bound <= 1 << 53:
                    # every partial sum is a whole number that a double holds
                    z = y.astype(np.float64)
                    total += (z.T @ z).astype(np.int64)
                else:
                    total += y.T @ y
                held += bound
        if held:
            yield out()

    found = rows.select("x").mapInArrow(run, "slot int, p long").groupBy("slot").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p"))
    sums_ = np.zeros((size, size), dtype=object)
    for r in found.toLocalIterator():
        i, j = divmod(r.slot, size)
        sums_[i, j] = sums_[j, i] = int(r.p)
    return sums_


def covariance(rows: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n), every entry rounded once to extended precision."""
    centre = [(2 * s + n) // (2 * n) for s in total]
    left = np.array([s - n * m for s, m in zip(total, centre, strict=True)], dtype=object)
    exact = products(rows, size, centre) * n - np.outer(left, left)
    # each integer in two halves of 60 bits, so that the extended precision gets all it can hold
    high = np.vectorize(lambda v: v >> 60, otypes=[object])(exact)
    low = exact - (high * (1 << 60))
    return (high.astype(np.longdouble) * np.longdouble(2) ** 60 + low.astype(np.longdouble)) / (np.longdouble(n) * np.longdouble(n))


def _clusters(values: np.ndarray, width: np.longdouble) -> list[np.ndarray]:
    """Runs of ascending values whose neighbours lie within `width`, of two or more."""
    runs = np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > width) + 1)
    return [r for r in runs if len(r) > 1]


def refined(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix by falling value, in extended precision.

    Starts from float32 eigenvectors. Each round computes, with extended products, R = I - X'X and S = X'AX, and adds
    X E, where E holds (s_ij + d_j r_ij) / (d_j - d_i), or r_ij / 2 where d_i and d_j can't be told apart.
    """
    size = len(matrix)
    a = matrix.astype(np.longdouble)
    scale = np.abs(a).max() or np.longdouble(1)
    a = a / scale
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start.astype(np.longdouble)
    one = np.eye(size, dtype=np.longdouble)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    d, before = np.diag(x.T @ a @ x), np.inf
    for turn in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        d = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(d, kind="stable")
        x, d, r, s = x[:, order], d[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        width = 2 * (np.linalg.norm((s - np.diag(d)).astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        gap = d[None, :] - d[:, None]
        apart = np.abs(gap) > width
        e = np.where(apart, (s + d[None, :] * r) / np.where(apart, gap, 1), r / 2)
        size_of = np.abs(e).max()
        if turn and size_of >= before / 4 and size_of < 1e-12:
            break
        before = size_of
        x = x + x @ e
        for own in _clusters(d, width):
            part = x[:, own]
            middle = d[own].mean()
            inner = part.T @ (a @ part - middle * part)
            inner = (inner + inner.T) / 2
            spread = np.abs(inner).max()
            if spread == 0:
                continue
            _, turn_by = np.linalg.eigh((inner / spread).astype(np.float64))
            x[:, own] = part @ turn_by.astype(np.longdouble)
    for _ in range(2):
        # close eigenvalues divide rounding errors by their gap; this makes the vectors orthogonal again
        x = x + x @ (one - x.T @ x) / 2
    d = np.array([(x[:, j] @ (a @ x[:, j])) / (x[:, j] @ x[:, j]) for j in range(size)], dtype=np.longdouble) * scale
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-d, kind="stable")
    return d[order], x[:, order]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict | None:
    """Model of the prepared `rows` (saved, all of one length): count, sums, falling eigenvalues and their vectors."""
    first = rows.select(F.size("x").alias("size")).first()
    if first is None:
        return None
    size = first[0]
    n, total = sums(rows, size)
    matrix = covariance(rows, size, n, total)
    values, found = refined(matrix)
    trace = np.trace(matrix)
    keep = int((values[: min(components, size)] > trace * NO_VARIANCE).sum()) if trace > 0 else 0
    return {"n": n, "sums": total, "values": values[:keep], "vectors": found[:, :keep], "trace": trace, "size": size}


def scores(rows: DataFrame, model: dict) -> DataFrame:
    """(id, x, deviation, whitened) per row: exact squared deviation (n x - S)^2, and one double per component."""
    n, size = model["n"], model["size"]
    centre = [s // n for s in model["sums"]]
    middle = np.array(centre, dtype=np.int64)
    # what the mean has beyond its whole part, in [0, 1)
    beyond = np.array([float(Fraction(s - n * m, n)) for s, m in zip(model["sums"], centre, strict=True)])
    left = np.array([s - n * m for s, m in zip(model["sums"], centre, strict=True)], dtype=object)
    project = (model["vectors"] / np.sqrt(model["values"])).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                y = _matrix(part.column(1), size) - middle
                white = (y - beyond) @ project
                reach = (int(np.abs(y).max()) + 1) * n
                if reach * reach * size < 1 << 62:
                    wide = y * n - left.astype(np.int64)
                    deviation = [str(v) for v in (wide * wide).sum(axis=1).tolist()]
                else:
                    wide = y.astype(object) * n - left
                    deviation = [str(v) for v in (wide * wide).sum(axis=1)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, max(white.shape[1], 1), dtype=np.int32)[: len(white) + 1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation), flat], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(white: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the covariance of `whitened`, less the identity."""
    upper = np.triu_indices(components)
    slots = pa.array(np.concatenate([upper[0] * components + upper[1], components * components + np.arange(components)]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, line, seen = np.zeros((components, components)), np.zeros(components), False
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                w = _matrix(batch.column(0).slice(start, STEP), components)
                square, line, seen = square + w.T @ w, line + w.sum(axis=0), True
        if seen:
            yield pa.RecordBatch.from_arrays([slots, pa.array(np.concatenate([square[upper], line]))], names=["slot", "p"])

    # the rows are centred already, up to rounding, which the means take out
    gathered = white.select("whitened").mapInArrow(run, "slot int, p double").groupBy("slot").agg(F.sum("p").alias("p"))
    flat = np.zeros(components * (components + 1))
    for r in gathered.toLocalIterator():
        flat[r.slot] = r.p
    square = flat[: components * components].reshape(components, components) / n
    mean = flat[components * components :] / n
    square = np.triu(square) + np.triu(square, 1).T - np.outer(mean, mean)
    return float(np.abs(square - np.eye(components)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) per remaining row, with arrays over the components.

    `deviation` is a decimal(38,0), since it grows with the square of the rows.
    """
    rows = saved(prepared(vectors, key, vector, scale, shift), "vectors")
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows if usual is None else rows.filter(F.size("x") == usual["size"])
    model = fit(rows, components)
    if model is None or not len(model["values"]):
        none = [F.lit(None).cast(t).alias(c) for c, t in [("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double")]]
        return rows.select(F.col("id").alias(key), *none).limit(0)
    white = saved(scores(rows, model), "whitened")
    error = identity_error(white, len(model["values"]), model["n"])
    explained = F.array(*[F.lit(float(v / model["trace"])) for v in model["values"]])
    return white.select(
        F.col("id").alias(key), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )


def long_form(white: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per row and component, numbered from 1; `deviation` as long, null where it is beyond one."""
    zipped = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z")
    wide = white.select(quoted(key), "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", zipped)
    return wide.select(quoted(key), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "z.whitened", "z.explained", "identity_error")

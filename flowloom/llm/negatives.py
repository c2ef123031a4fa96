"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c, whose members lie within the angle b of it, no member a
can score more than |a| |x| cos(max(0, angle(c, x) - b)) with a candidate x. The cluster sorts its candidates by that
bound once; every member walks the list, in steps of `STEP` candidates, and stops as soon as the next bound certifies
that nothing better can follow. First each anchor walks for its best candidates of its own label, the positives. Each
positive then opens a band of scores, and the anchor walks again for the best candidates of other labels inside each
band.

The list of a cluster is kept in blocks: candidates are dealt by their own nearest centre and by hash, at most about
`BLOCK` together, and a block has the largest bound of its candidates for every cluster. The `HEAD` blocks with the
largest bounds are walked first. What was found there rules out blocks as wholes: a block meets a cluster only if its
bound reaches what some member still needs, and is walked with these needs from the start. Clusters that meet a block
share one copy of it, up to `BUNDLE` anchors; larger clusters are cut. So a task holds one block and one bundle, and all
scores are exact integers.

Centres come from a sample of about `SAMPLE` anchors; they affect the speed alone, since every bound is certified.

Edge cases: rows with a null id or label, or whose vector is null, empty, or holds null or non-finite entries, take no
part; nor do vectors whose squared length after scaling reaches 2^62, whose scores no long could hold, and vectors whose
length isn't the most frequent one. Zero vectors score 0. Rows that repeat an id are rows of their own, as anchors and as
candidates; a copy of an anchor can be its positive. Ties go to the smaller id, then the earlier row. A positive whose
score is negative has an empty band. An empty table, or one without anchors, gives an empty one. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import narrow, quoted, saved

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of the positive's score.
LOW, HIGH = 50, 95
SAMPLE, CLUSTERS, MEMBERS = 8192, 256, 256
BLOCK, BUNDLE, HEAD, STEP = 8192, 4096, 2, 512
#: Angles are widened by this, since arc cosines of unit vectors are no more exact.
SLACK = 1e-7
NONE = -(1 << 62)


def prepared(vectors: DataFrame, anchor: Column, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(row, id, label, anchor, size, v) of the rows that take part; v holds little-endian 32-bit integers."""
    rows = vectors.select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    whole = whole.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    whole = whole.filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < float(1 << 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            packed = pa.array([part.tobytes() for part in np.split(flat, ends[:-1])] if len(ends) else [], pa.binary())
            size = pa.array(np.diff(ends, prepend=0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], size, packed], names=["id", "label", "anchor", "size", "v"])

    kinds = ", ".join(f"{n} {whole.schema[n].dataType.simpleString()}" for n in ("id", "label", "anchor"))
    return whole.mapInArrow(run, f"{kinds}, size int, v binary").withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer rows, as doubles, of a binary column."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.float64)


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, lengths); a zero row stays zero."""
    length = np.linalg.norm(rows, axis=1)
    return rows / np.where(length > 0, length, 1)[:, None], length


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a spherical k-means over the sample's rows."""
    unit = directions(sample)[0]
    rng = np.random.default_rng(11)
    found = unit[rng.choice(len(unit), min(count, len(unit)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(unit @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, unit)
        used = np.linalg.norm(sums, axis=1) > 0
        found[used] = directions(sums[used])[0]
    return found


def homes(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """`rows` with the nearest centre and the angle to it (0 for a zero vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, length = directions(matrix(batch.column("v")))
            cosine = unit @ centre.T
            home = np.argmax(cosine, axis=1)
            angle = np.where(length > 0, np.arccos(np.clip(cosine[np.arange(len(home)), home], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "home", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, home int, angle double")


def block_bounds(blocks: DataFrame, centre: np.ndarray, width: np.ndarray) -> DataFrame:
    """(home, chunk, cluster, bound): the most that a unit anchor of the cluster can score in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, at = np.unique(np.stack([home, chunk], axis=1), axis=0, return_inverse=True)
            # a centre without anchors has no width, hence no bounds
            most = np.full((len(own), len(centre)), -np.inf)
            np.maximum.at(most, at.ravel(), bounds(matrix(batch.column(2)), centre, width))
            block, cluster = np.nonzero(np.isfinite(most))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[block, 0]), pa.array(own[block, 1]), pa.array(cluster.astype(np.int32)), pa.array(most[block, cluster])],
                names=["home", "chunk", "cluster", "bound"],
            )

    found = blocks.select("home", "chunk", "v").mapInArrow(run, "home int, chunk int, cluster int, bound double")
    return found.groupBy("home", "chunk", "cluster").agg(F.max("bound").alias("bound"))


def bounds(rows: np.ndarray, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Per row and centre, the most that a unit vector within `width` of the centre can score with the row."""
    unit, length = directions(rows)
    angle = np.arccos(np.clip(unit @ centre.T, -1, 1)) - width - SLACK
    return length[:, None] * np.cos(np.maximum(angle, 0))


def exact_scores(left: np.ndarray, right: np.ndarray, reach: float) -> np.ndarray:
    """Integer inner products of all rows of both; `reach` bounds them."""
    if reach < 1 << 52:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def walk(group: pa.Table, centre: np.ndarray, wanted: int, same: bool) -> pa.Table:
    """The best candidates in one block, per request of the anchors of one bundle.

    A request is a band [low, high] of scores; `need` is a score that as many candidates of other blocks reach as are
    wanted, so that what scores less is of no use.
    """
    asks = group.column("asks").to_numpy()
    label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    row, ident = group.column("row").to_numpy(), group.column("id").combine_chunks()
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((row, pc.rank(ident, tiebreaker="dense").to_numpy()))] = np.arange(len(row))
    vector = matrix(group.column("v"))
    length = np.linalg.norm(vector, axis=1)
    candidates = np.flatnonzero(~asks)
    cluster = group.column("cluster").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for own in np.unique(cluster[asks]):
        members = np.flatnonzero(asks & (cluster == own))
        turned = [m for m in members if length[m] > 0]
        angles = np.arccos(np.clip(directions(vector[turned])[0] @ centre[own], -1, 1)) if turned else np.zeros(1)
        bound = bounds(vector[candidates], centre[[own]], angles.max() + SLACK)[:, 0]
        order = np.argsort(-bound, kind="stable")
        listed, bound = candidates[order], bound[order]
        for first in range(0, len(members), STEP):
            some = members[first : first + STEP]
            requests = [group.column(c).take(pa.array(some)).combine_chunks() for c in ("low", "high", "need")]
            many = requests[0].value_lengths().to_numpy()
            low, high, need = (x.flatten().to_numpy().copy() for x in requests)
            asker = np.repeat(np.arange(len(some)), many)
            number = np.arange(len(asker)) - np.repeat(np.cumsum(many) - many, many)
            by, at, score = _walk_list(vector, length, label, row, rank, some, asker, low, high, need, listed, bound, wanted, same)
            out.append((row[some[asker[by]]], number[by], at, score))
    anchor, number, at, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"anchor": anchor, "request": number.astype(np.int32), "id": ident.take(pa.array(at)), "row": row[at], "score": score})


def _walk_list(vector, length, label, row, rank, members, asker, low, high, need, listed, bound, wanted, same):
    """(request, place, score) of the best of a shared list, for the requests of some members of its cluster.

    `listed` falls by `bound`. A request leaves the walk when the next bound, times its member's length, is less than
    what it needs: its `wanted`-th best score so far.
    """
    reach = float(length[members].max() * (length[listed].max() if len(listed) else 0))
    by_, at_, score_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(listed), STEP):
        most = bound[start] * length[members]
        live = np.flatnonzero(need <= (most + np.abs(most) * 1e-9 + 1e-6)[asker])
        if not len(live):
            break
        part = listed[start : start + STEP]
        active, place = np.unique(asker[live], return_inverse=True)
        score = exact_scores(vector[members[active]], vector[part], reach)
        theirs = (label[members[active]][:, None] == label[part][None, :]) == same
        theirs &= row[members[active]][:, None] != row[part][None, :]
        score = np.where(theirs, score, NONE)[place]
        fit = (score >= need[live][:, None]) & (score <= high[live][:, None]) & (score > NONE)
        if len(part) > wanted:
            top = np.partition(np.where(fit, score, NONE), len(part) - wanted, axis=1)[:, len(part) - wanted]
            fit &= score >= top[:, None]
        by, at = np.nonzero(fit)
        if not len(by):
            continue
        by_, at_, score_ = np.concatenate([by_, live[by]]), np.concatenate([at_, part[at]]), np.concatenate([score_, score[by, at]])
        best = np.lexsort((rank[at_], -score_, by_))
        by_, at_, score_ = by_[best], at_[best], score_[best]
        place = np.arange(len(by_)) - np.searchsorted(by_, by_, "left")
        last = place == wanted - 1
        need[by_[last]] = np.maximum(need[by_[last]], score_[last])
        first = place < wanted
        by_, at_, score_ = by_[first], at_[first], score_[first]
    return by_, at_, score_


class Lists:
    """The shared lists: blocks of candidates, anchors with their clusters, and the bounds between them."""

    def __init__(self, rows: DataFrame, anchors: int):
        self.spark = rows.sparkSession
        chosen = rows.filter("anchor")
        if anchors > SAMPLE:
            chosen = chosen.filter(F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * (SAMPLE / anchors)))
        sample = matrix(chosen.select("v").toArrow().column(0))
        self.centre = centres(sample, min(CLUSTERS, -(-anchors // MEMBERS)))
        count = len(self.centre)
        placed = saved(homes(rows, self.centre), "placed")
        sizes, members, width = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count)
        for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m"), F.max(F.when(F.col("anchor"), F.col("angle"))).alias("w")).collect():
            sizes[r.home], members[r.home], width[r.home] = r.n, r.m, r.w or 0.0
        self.parts = np.maximum(-(-members // BUNDLE), 1)
        # small clusters share a bundle
        self.bundle, held, number = np.zeros(count, np.int64), 0, 0
        for k in range(count):
            if held and held + members[k] > BUNDLE:
                held, number = 0, number + 1
            self.bundle[k], held = number, held + members[k]
        chunks = self._per_cluster(np.maximum(-(-sizes // BLOCK), 1), F.col("home"))
        self.blocks = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks).cast("int"))
        self.anchors = placed.filter("anchor").select("row", "id", "label", "v", F.col("home").alias("cluster"))
        found = block_bounds(self.blocks, self.centre, np.where(members > 0, width + SLACK, np.nan))
        by_bound = Window.partitionBy("cluster").orderBy(F.desc("bound"), "home", "chunk")
        # blocks and clusters, not rows: one entry per BLOCK candidates and cluster
        self.bounds = saved(found.withColumn("place", F.row_number().over(by_bound)), "bounds")

    def _per_cluster(self, values: np.ndarray, cluster: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v.item()) for v in values]), cluster + 1)

    def _walked(self, pairs: DataFrame, asks: DataFrame, wanted: int, same: bool) -> DataFrame:
        """(anchor, request, id, row, score) of the best candidates in the blocks of `pairs` (home, chunk, cluster)."""
        bundle, parts = self._per_cluster(self.bundle, F.col("cluster")), self._per_cluster(self.parts, F.col("cluster"))
        pairs = pairs.select("home", "chunk", "cluster", bundle.alias("bundle"), parts.alias("parts"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<int>"))
        targets = pairs.withColumn("part", every).select("home", "chunk", "bundle", "part").distinct()
        none = F.lit(None).cast("array<long>")
        columns = ["home", "chunk", "bundle", "part", "row", "id", "label", "v"]
        candidates = self.blocks.join(narrow(targets), ["home", "chunk"]).select(
            *columns, F.lit(False).alias("asks"), F.lit(0).alias("cluster"), none.alias("low"), none.alias("high"), none.alias("need")
        )
        part = F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts")).cast("int")
        askers = asks.join(narrow(pairs), "cluster").withColumn("part", part).select(*columns, F.lit(True).alias("asks"), "cluster", "low", "high", "need")
        centre = self.centre

        def run(group: pa.Table) -> pa.Table:
            return walk(group, centre, wanted, same)

        kind = asks.schema["id"].dataType.simpleString()
        met = candidates.unionByName(askers).groupBy("home", "chunk", "bundle", "part")
        return met.applyInArrow(run, f"anchor long, request int, id {kind}, row long, score long")

    def best(self, asks: DataFrame, wanted: int, same: bool) -> DataFrame:
        """(anchor, request, id, row, score, rank) of the best candidates of every request in `asks`, ranked from 1.

        `asks` has (row, id, label, v, cluster, low, high), the last two arrays with a band per request.
        """
        # an empty band needs nothing
        asks = saved(asks.withColumn("need", F.zip_with("low", "high", lambda a, b: F.when(a > b, F.lit(-NONE)).otherwise(a))), "asks")
        head = saved(self._walked(self.bounds.filter(F.col("place") <= HEAD), asks, wanted, same), "head")
        reached = self._ranked(head, wanted).filter(F.col("rank") == wanted).select("anchor", "request", "score")
        reached = reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("request", "score"))).alias("reached"))
        known = asks.join(reached, asks["row"] == reached["anchor"], "left").drop("anchor")
        need = F.transform("need", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i), F.lit(NONE))))
        known = saved(known.withColumn("need", need).drop("reached"), "asks")
        length = self._length(known)
        least = length.groupBy("cluster").agg(F.min(F.when(F.col("length") > 0, F.col("least") / F.col("length")).otherwise(F.lit(float("-inf")))).alias("floor"))
        rest = self.bounds.filter(F.col("place") > HEAD).join(narrow(saved(least, "floors")), "cluster")
        rest = rest.filter(F.col("bound") + F.abs("bound") * 1e-9 + 1e-6 >= F.col("floor")).select("home", "chunk", "cluster", "place")
        tail = saved(self._walked(saved(rest, "pairs"), known, wanted, same), "tail")
        return self._ranked(head.unionByName(tail), wanted)

    def _length(self, asks: DataFrame) -> DataFrame:
        """(cluster, length, least): an anchor's length and the least score that any of its requests can use."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    length = np.linalg.norm(matrix(batch.column(2)), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), batch.column(1)], names=["cluster", "length", "least"])

        return asks.select("cluster", F.array_min("need").cast("double").alias("least"), "v").mapInArrow(run, "cluster int, length double, least double")

    @staticmethod
    def _ranked(found: DataFrame, wanted: int) -> DataFrame:
        order = Window.partitionBy("anchor", "request").orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def mine(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` is true.

    Components count as floor(scale * x). An anchor's positives are the `positives` best other rows of its label; for each,
    the `negatives` best rows of other labels come whose score is at least `low` and at most `high` percent of its own.
    """
    rows = saved(prepared(vectors, anchor, key, vector, label, scale), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows if usual is None else rows.filter(F.col("size") == usual["size"])
    anchors = rows.filter("anchor").count()
    if not anchors:
        return rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    lists = Lists(rows, anchors)
    whole = lists.anchors.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(-NONE))})
    found = lists.best(whole, positives, same=True).select("anchor", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("request"))
    found = saved(found, "positives")
    share = lambda s, percent: s.cast("decimal(38,0)") * F.lit(percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("request", "positive_score"))), lambda x: x.positive_score)
    bands = found.groupBy("anchor").agg(scores.alias("scores")).select(
        "anchor",
        F.transform("scores", lambda s: F.when(s < 0, F.lit(1)).otherwise(F.ceil(share(s, low)).cast("long"))).alias("low"),
        F.transform("scores", lambda s: F.when(s < 0, F.lit(0)).otherwise(F.floor(share(s, high)).cast("long"))).alias("high"),
    )
    asks = lists.anchors.join(bands, lists.anchors["row"] == bands["anchor"]).drop("anchor")
    hard = lists.best(asks, negatives, same=False)
    joined = found.join(hard.select("anchor", "request", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["anchor", "request"])
    ids = lists.anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return joined.join(narrow(ids), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

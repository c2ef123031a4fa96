"""Near-duplicate documents: a chosen-path join on shingles of five words, with exact verification.

Every set of shingles is embedded as `SKETCH` min-hash tokens, of which similar sets share as many as their Jaccard
similarity says. In each of `RUNS` runs a set follows the tokens that a run's hash chooses (1 / 0.8 on average), so
that two sets over the threshold are expected to meet once per run. A bucket that is still large is split on further
chosen tokens of its sets (`FURTHER` / 0.8 on average), unless its sets resemble each other on average: then splitting
can't help. Small buckets are compared pair by pair on the sketches; buckets that splitting can't help are classes of
sets that nearly all are alike. Both tie sets together to groups, and inside a group all pairs are compared exactly, block
by block, on the whole sets of shingles. That takes in everything that any bucket of any run held, so no pair is counted
twice and none of a bucket is lost.

A set is one row with the paths of its large buckets, so the joins that fetch sketches never have more rows than there
are sets, however many paths a large group of copies shares.

Recall: a pair with similarity 0.8 shares no chosen token in 12 runs with probability exp(-12). In a large bucket a path
that two sets share goes on to 1.25 shared ones on average, of which some survives `DEPTH` splits with probability 0.43: a
pair all of whose tokens lie in buckets that stay large that long is lost with probability exp(-12 * 0.43) = 0.006, one with
half of them there with exp(-8.6). In what is still large after `DEPTH` splits all pairs of sketches are compared. The estimate on a sketch lets a pair at 0.8 pass with probability 0.9999, and one at 0.5 with 0.0001, so half-alike
texts (templates, boilerplate) don't chain to groups by it. The average of `PROBES` tokens is rough: it can take a bucket of
half-alike sets for a class, which are then compared exactly for nothing.

Edge cases: a text that is null or has no word has no shingles and links with nothing; one of 1 to 4 words has itself
as its only shingle. Repeated rows, also with equal ids, are linked as copies; rows that repeat an id with another
text are documents of their own. A row with a null id keeps a row without links. An empty table gives an empty one.
Extra columns are ignored. Sets are told apart by 128 bits, and by 64 bits as nodes of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import connected_components, fresh, local_roots, narrow, quoted, release, saved, slices
from flowloom.llm.text import mix, normalized, shingles_of, unique_sorted, words_of

SHINGLE, THRESHOLD = 5, 0.8
SKETCH, RUNS, DEPTH = 128, 12, 6
#: Shared paths that a pair at the threshold goes on to in a split, on average.
FURTHER = 1.25
#: A bucket with more sets is split on.
SMALL = 24
#: Buckets whose sets agree on average in this share of tokens aren't split.
DENSE = 0.6
#: Least share of equal tokens for a pair of a small bucket to be verified.
ESTIMATE = 0.67
#: Tokens of a sketch that the average is taken of.
PROBES = 8
BLOCK_SHINGLES, BLOCK_SETS, COLUMNS = 1_000_000, 2048, 4096


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(77).integers(0, 1 << 62, (2, SKETCH), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values, offsets = shingles_of(*words_of(column), SHINGLE)
    return unique_sorted(values, offsets)


def set_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each set, 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_marks(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, low, high) of each set: its shingles, and 128 bits that tell it from others."""
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    high = np.zeros(len(sizes), np.uint64)
    if len(some):
        high[some] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x14057B7EF767814F)), offsets[some])
    return sizes, set_hash(values, offsets), high


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, low, high, sketch) per document: size of the set, 128 bits of it, and its min-hash tokens."""
    factors, shifts = _constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            values, offsets = shingle_sets(part.column(1))
            sizes, low, high = set_marks(values, offsets)
            some = np.flatnonzero(sizes)
            tokens = np.zeros((len(sizes), SKETCH), dtype=np.uint32)
            if len(some):
                at = offsets[some]
                for j in range(SKETCH):
                    tokens[some, j] = np.minimum.reduceat((values * factors[j] + shifts[j]) >> np.uint64(32), at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array([x.tobytes() for x in tokens], pa.binary())],
                names=["id", "n", "low", "high", "sketch"],
            )

    rows = docs.select(F.col(quoted(key)).cast("long").alias("id"), normalized(F.col(quoted(text))).alias("t"))
    return rows.mapInArrow(run, "id long, n long, low long, high long, sketch binary")


def paths(members: DataFrame, start: bool) -> DataFrame:
    """(path, rep) for every token a set chooses: from scratch for each run, or below each of its `paths`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, RUNS + 1, dtype=np.uint64))
        limit = np.uint64(int((1 if start else FURTHER) / THRESHOLD / SKETCH * 2**64))
        place = np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                tokens = mix(np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]).astype(np.uint64) | place)
                if start:
                    many, owner, before = RUNS, np.tile(np.arange(len(tokens)), RUNS), np.repeat(seeds, len(tokens))
                else:
                    lists = batch.column(2)
                    many = max(1, int(np.ceil(len(lists.flatten()) / len(tokens))))
                    owner = np.repeat(np.arange(len(tokens)), lists.value_lengths().to_numpy())
                    before = lists.flatten().to_numpy().view(np.uint64)
                # about as many pairs of a set and a path at a time as there are sets
                for own, old in zip(np.array_split(owner, many), np.array_split(before, many), strict=True):
                    path = mix(tokens[own] + old[:, None])
                    row, column = np.nonzero(path < limit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix(path[row, column] + np.uint64(1)).view(np.int64)), batch.column(0).take(pa.array(own[row]))], names=["path", "rep"]
                    )

    chosen = members.select("rep", "sketch") if start else members.select("rep", "sketch", "paths")
    return chosen.mapInArrow(run, "path long, rep long")


def agreement(members: DataFrame, sized: DataFrame) -> DataFrame:
    """(path, alike): the share of equal tokens of two sets of a bucket, on average over all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()])[:, :: SKETCH // PROBES]
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(tokens)), lists.value_lengths().to_numpy())
            path = lists.flatten().to_numpy()
            for j in range(PROBES):
                key, count = np.unique(np.stack([path, tokens[owner, j].astype(np.int64)], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[:, 0]), pa.array(np.full(len(key), j, np.int32)), pa.array(key[:, 1]), pa.array(count)], names=["path", "j", "token", "c"]
                )

    counts = members.select("rep", "sketch", "paths").mapInArrow(run, "path long, j int, token long, c long")
    per_token = counts.groupBy("path", "j", "token").agg(F.sum("c").cast("double").alias("c"))
    equal = per_token.groupBy("path").agg(F.sum(F.col("c") * F.col("c")).alias("equal"))
    return equal.join(sized, "path").select("path", (F.col("equal") / PROBES / F.col("size") / F.col("size")).alias("alike"))


def alike_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(rep, first): a forest of the pairs of each bucket whose sketches agree, all pairs compared block by block."""

    def run(group: pa.Table) -> pa.Table:
        reps, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        tokens = np.stack([np.frombuffer(t, np.uint32) for t in group.column("sketch").to_pylist()])
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found = [(left[:0], right[:0])]
        for top in range(0, len(left), 64):
            rows = left[top : top + 64]
            a, b = np.nonzero((tokens[rows][:, None, :] == tokens[right][None, :, :]).mean(axis=2) >= ESTIMATE)
            found.append((rows[a], right[b]))
        roots = local_roots(len(reps), *(np.concatenate(ends) for ends in zip(*found, strict=True)))
        tied = np.flatnonzero(roots != np.arange(len(reps)))
        return pa.table({"rep": reps[tied], "first": reps[roots[tied]]})

    blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("x"), F.greatest(i, F.col("block")).alias("y")))
    rows = members.withColumn("block", mine).withColumn("p", F.explode(meetings)).join(sketches, "rep")
    dealt = rows.select("path", "rep", "sketch", "block", "p.x", "p.y")
    return dealt.groupBy("path", "x", "y").applyInArrow(run, "rep long, first long").distinct()


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(rep, grp) of all sets that some bucket ties to another; grp is the smallest rep of the group."""
    sketches = reps.select("rep", "sketch")
    level = saved(paths(sketches, True).distinct(), "paths")
    small, ties = [], []

    def one_row_per_set(rows: DataFrame) -> DataFrame:
        return rows.groupBy("rep").agg(F.collect_list("path").alias("paths")).join(sketches, "rep").select("rep", "sketch", "paths")

    for depth in range(DEPTH + 1):
        release(reps.sparkSession)
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first"))
        sized = saved(sizes.filter("size > 1"), "buckets")
        held = saved(level.join(narrow(sized), "path"), "held")
        buckets = held.filter(F.col("size") <= SMALL).groupBy("path").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
        # written per level, so that no plan spans all levels
        small.append(saved(buckets.select("reps").distinct(), "small"))
        large = held.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            ties.append(saved(alike_pairs(large, sketches), "ties"))
            break
        alike = agreement(saved(one_row_per_set(large), "members"), sized)
        dense = narrow(saved(alike.filter(F.col("alike") >= DENSE).select("path"), "dense"))
        ties.append(saved(large.join(dense, "path", "left_semi").select("rep", "first").distinct(), "ties"))
        rest = saved(one_row_per_set(large.join(dense, "path", "left_anti")), "members")
        if rest.isEmpty():
            break
        level = saved(paths(rest, False).distinct(), "paths")
    pairs = small[0]
    for more in small[1:]:
        pairs = pairs.unionByName(more)
    pair = F.explode(F.flatten(F.transform("reps", lambda x, i: F.transform(F.slice("reps", i + 2, F.size("reps")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    met = pairs.select(pair.alias("p")).select("p.a", "p.b").distinct()
    one, other = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = met.join(one, "a").join(other, "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * (THRESHOLD - 1e-9))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, SKETCH) for c in batch.columns[2:])
            good = (a == b).mean(axis=1) >= ESTIMATE
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good))

    edges = saved(near.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long"), "pairs")
    release(reps.sparkSession)
    for tie in ties:
        edges = edges.unionByName(tie.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    return connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def compare(group: pa.Table) -> pa.Table:
    """Exact links between the sets of one pair of blocks (or inside one): sums per set, and a forest."""
    # rows that repeat a representative's id and text bring its set again
    group = group.take(pa.array(np.unique(group.column("rep").to_numpy(), return_index=True)[1]))
    reps, weights, block = (group.column(c).to_numpy() for c in ("rep", "weight", "block"))
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, slot, counts = np.unique(everything, return_inverse=True, return_counts=True)
    shared = counts > 1
    renumbered = np.cumsum(shared) - 1
    used = shared[slot]
    slot, owner = renumbered[slot[used]], owner[used]
    by_slot = np.argsort(slot, kind="stable")
    slot, owner = slot[by_slot], owner[by_slot]
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    place = np.empty(len(sets), dtype=np.int64)
    place[right] = np.arange(len(right))
    place[left] = np.arange(len(left))
    n_links, found_a, found_b = np.zeros(len(sets), dtype=np.int64), [], []
    in_left = block[owner] == x
    for top in range(0, len(left), 1024):
        rows = left[top : top + 1024]
        common = np.zeros((len(rows), len(right)), dtype=np.float32)
        for first in range(0, int(shared.sum()), COLUMNS):
            span = slice(*np.searchsorted(slot, [first, first + COLUMNS]))
            s, o, l = slot[span] - first, owner[span], in_left[span]
            one, two = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            inside = l & (place[o] >= top) & (place[o] < top + len(rows))
            if not inside.any():
                continue
            one[place[o[inside]] - top, s[inside]] = 1
            others = block[o] == y
            two[place[o[others]], s[others]] = 1
            common += one @ two.T
        union = sizes[rows][:, None] + sizes[right][None, :] - common
        a, b = np.nonzero(common.astype(np.float64) / union >= THRESHOLD)
        a, b = rows[a], right[b]
        if x == y:
            a, b = a[a < b], b[a < b]
        np.add.at(n_links, a, weights[b])
        np.add.at(n_links, b, weights[a])
        # only a forest goes on, so that a group of copies never becomes a list of its pairs
        roots = local_roots(len(sets), a, b)
        tied = np.flatnonzero(roots != np.arange(len(sets)))
        found_a.append(tied)
        found_b.append(roots[tied])
    roots = local_roots(len(sets), np.concatenate(found_a), np.concatenate(found_b))
    linked = np.flatnonzero(n_links)
    return pa.table({"rep": pa.array(reps[linked], pa.int64()), "links": pa.array(n_links[linked]), "root": pa.array(reps[roots[linked]], pa.int64())})


def exact_links(docs: DataFrame, text: str, key: str, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, links, root): for every set, the linked documents of other sets, and a forest of the links."""
    sized = groups.join(reps.select("rep", "id", "n", "weight"), "rep")
    blocks = sized.groupBy("grp").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks")
    )
    chosen = narrow(saved(sized.join(blocks, "grp").select("id", "rep", "weight", "grp", "blocks"), "groups"))
    rows = docs.select(F.col(quoted(key)).cast("long").alias("id"), normalized(F.col(quoted(text))).alias("t")).join(chosen, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            values, offsets = shingle_sets(part.column(0))
            found = pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([*part.columns[1:], found], names=["rep", "weight", "grp", "blocks", "shingles"])
            # a row that repeats the id with another text isn't the representative
            yield out.filter(pa.array(set_hash(values, offsets).view(np.int64) == out.column(0).to_numpy()))

    single = rows.select("t", "rep", "weight", "grp", "blocks").mapInArrow(sets, "rep long, weight long, grp long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("x"), F.greatest(i, F.col("block")).alias("y")))
    dealt = single.withColumn("block", own).withColumn("p", F.explode(meetings)).select("rep", "weight", "grp", "block", "shingles", "p.x", "p.y")
    return saved(dealt.groupBy("grp", "x", "y").applyInArrow(compare, "rep long, links long, root long"), "links")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, n, low, high, n_links, component_id) per row: its set, other rows linked directly, smallest id reachable."""
    signed = saved(signatures(docs, text, key), "signatures")
    filled = signed.filter("n > 0 and id is not null")
    reps = saved(filled.groupBy("n", "low", "high").agg(F.min_by("sketch", "id").alias("sketch"), F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.col("low")), "sets")
    groups = saved(candidate_groups(reps), "candidates")
    release(docs.sparkSession)
    found = exact_links(docs, text, key, reps, groups)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    tied = reps.select("n", "low", "high", "rep", "id", "weight").join(sums, "rep", "left").join(component, "rep", "left")
    tied = tied.withColumns({"component": F.coalesce("component", "rep"), "n_links": F.coalesce("links", F.lit(0)) + F.col("weight") - 1})
    tied = saved(tied.select("n", "low", "high", "id", "component", "n_links"), "classes")
    smallest = tied.groupBy("component").agg(F.min("id").alias("component_id"))
    per_set = tied.join(smallest, "component").select("n", "low", "high", "n_links", "component_id")
    joined = signed.select("id", "n", "low", "high").join(per_set, ["n", "low", "high"], "left")
    links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("id", "n", "low", "high", links.alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component_id, n_links, kept) per row: smallest id reachable by links, and other rows linked directly."""
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return classes(docs, text, key).select(F.col("id").alias(key), "component_id", "n_links", kept.alias("kept"))


def one_per_group(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` without the near-duplicates of others: of each group the row with the smallest id stays.

    A row is told by its id and, where ids repeat, by its set of shingles too, so a row stays whatever becomes of another
    with its id. Of rows that share id and set one stays, any of them. Rows with a null id, or without a word, have no links
    and all stay.
    """
    judged = saved(classes(docs, text, key).filter("id is not null").select("id", "n", "low", "high", (F.col("id") == F.col("component_id")).alias("kept")), "judged")
    own, columns = F.col(quoted(key)).cast("long"), [quoted(c) for c in docs.columns]
    name = fresh(docs, "own_id")
    named = docs.withColumn(name, own)
    again = saved(judged.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("all_kept")).filter("rows > 1").select(F.col("id").alias(name)), "repeated")
    gone = judged.filter(~F.col("kept")).select(F.col("id").alias(name)).distinct()
    if again.isEmpty():
        return named.join(narrow(saved(gone, "gone")), name, "left_anti").select(*columns)
    again = narrow(again)
    single = named.join(again, name, "left_anti").join(narrow(saved(gone, "gone")), name, "left_anti")
    several = named.join(again, name, "left_semi")
    marks, words = [fresh(docs, m) for m in ("n", "low", "high")], fresh(docs, "words")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, words):
            sizes, low, high = set_marks(*shingle_sets(part.column(part.num_columns - 1)))
            hashes = [pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *hashes], names=[*part.schema.names[:-1], *marks])

    schema = T.StructType([*several.schema.fields, *[T.StructField(m, T.LongType()) for m in marks]])
    marked = several.withColumn(words, normalized(F.col(quoted(text)))).mapInArrow(sets, schema)
    kept = judged.filter("kept").select(F.col("id").alias(name), *[F.col(c).alias(m) for c, m in zip(("n", "low", "high"), marks, strict=True)]).distinct()
    filled = marked.filter(F.col(quoted(marks[0])) > 0).join(kept, [name, *marks], "left_semi").dropDuplicates([name, *marks])
    return single.select(*columns).unionByName(filled.select(*columns)).unionByName(marked.filter(F.col(quoted(marks[0])) == 0).select(*columns))

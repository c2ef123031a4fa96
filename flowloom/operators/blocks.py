"""Field-presence blocks: grouping rows and columns by which fields are set, and merging the groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import jaccard
from flowloom.operators.columns import drop_all_null_columns, pad_nulls, wide_to_long
from flowloom.operators.encode import integer_code
from flowloom.operators.trees import dotted_edges
from flowloom.scale import c, small_side, sorted_rank
from flowloom.session import stored

# fixed value: the name of the group that takes unmerged blocks
DEFAULT_EXPERT = "default_expert"
#: Fields per number of a presence bitmap.
WORD = 63


# -- fingerprints and blocks ------------------------------------------------------------------------------------


def fingerprint(fields: Sequence[str]) -> Column:
    """Names of the set fields in column order, joined by `|`."""
    return F.concat_ws("|", *[F.when(c(name).isNotNull(), F.lit(name)) for name in fields])


def row_bytes(fields: Sequence[str]) -> Column:
    return sum((F.coalesce(F.length(c(name)), F.lit(0)) for name in fields), F.lit(0)).cast("long")


def presence(fields: Sequence[str]) -> list[Column]:
    """Which fields are set, as bits: one 64-bit number per 63 fields, named `_set0`, `_set1` and so on."""
    words = []
    for number, start in enumerate(range(0, max(len(fields), 1), WORD)):
        bits = [F.when(c(name).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, name in enumerate(fields[start : start + WORD])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).cast("long").alias(f"_set{number}"))
    return words


def set_names(fields: Sequence[str]) -> list[str]:
    return [f"_set{number}" for number in range(-(-max(len(fields), 1) // WORD))]


def fields_set(fields: Sequence[str]) -> Column:
    """The names of the set fields, in column order, from the bits of `presence`."""

    def named(number: int) -> Column:
        names = F.array(*[F.lit(name) for name in fields[number * WORD : (number + 1) * WORD]]).cast("array<string>")
        return F.filter(names, lambda _, k: F.getbit(F.col(f"_set{number}"), k) == 1)

    return F.concat(*[named(number) for number in range(len(set_names(fields)))])


def block_table(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per distinct set of fields: block_id in fingerprint order, fingerprint, rows, bytes, schema, bits.

    Packets are scanned once, here, and grouped by the bits of their fields; texts are made from one row per pattern. The
    numbers come from ranges of the fingerprints, so no window sees all patterns. The result is materialised (see
    `small_side`): plans and similarities work on this metadata alone.
    """
    bits = set_names(fields)
    patterns = df.groupBy(*presence(fields)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_bytes(fields)).alias("n_bytes"))
    named = patterns.withColumn("schema", fields_set(fields)).withColumn("fingerprint", F.array_join("schema", "|"))
    ranged = named.repartitionByRange("fingerprint").withColumn("_range", F.spark_partition_id())
    # written down, since sampled edges may differ when they are computed again
    ranked = sorted_rank(stored(ranged, "patterns"), [F.col("fingerprint")], F.col("_range"), name="_rank")
    return small_side(
        ranked.select(
            (F.col("_rank") - 1).alias("block_id"),
            "fingerprint",
            F.md5("fingerprint").alias("fingerprint_md5"),
            "n_rows",
            "n_bytes",
            "schema",
            *bits,
        )
    )


def assign_blocks(df: DataFrame, fields: Sequence[str], blocks: DataFrame) -> DataFrame:
    """Add `fingerprint` and `block_id`, joined by the bits of the set fields; the lookup is broadcast only if it is small."""
    bits = set_names(fields)
    lookup = small_side(blocks.select(*bits, "fingerprint", "block_id"))
    return df.select("*", *presence(fields)).join(lookup, bits).drop(*bits)


def block_slice(df: DataFrame, block_id: int, schema: Sequence[str], index: str, label: str = "label") -> DataFrame:
    """Rows and columns of one block, index first and label last."""
    return df.filter(F.col("block_id") == block_id).select(
        c(index).alias("index"), *[c(name) for name in schema], c(label)
    )


# -- blocks of columns ------------------------------------------------------------------------------------------


def column_signatures(df: DataFrame, fields: Sequence[str], row_id: str) -> DataFrame:
    """(position, field, signature) where equal signatures mean equal sets of non-null rows.

    A signature is the row count and two 64-bit xor sums of row hashes, so row sets are compared without collecting
    them.
    """
    first, second = F.xxhash64(c(row_id)), F.xxhash64(c(row_id), F.lit("second"))

    def signature(name: str) -> Column:
        set_here = c(name).isNotNull()
        return F.concat_ws(
            ":",
            F.count(F.when(set_here, 1)).cast("string"),
            F.coalesce(F.bit_xor(F.when(set_here, first)), F.lit(0)).cast("string"),
            F.coalesce(F.bit_xor(F.when(set_here, second)), F.lit(0)).cast("string"),
        )

    one_row = df.agg(*[signature(name).alias(name) for name in fields])
    named = wide_to_long(one_row, fields, "field", "signature")
    position = F.array_position(F.array(*[F.lit(n) for n in fields]), F.col("field")).cast("long") - 1
    return named.withColumn("position", position)


def column_blocks(signatures: DataFrame, kind: str = "discrete") -> DataFrame:
    """(field, position, block): columns with equal row sets; `continuous` only joins adjacent columns.

    Windows here see one row per column of the table.
    """
    whole = Window.partitionBy(F.lit(0))
    in_order = whole.orderBy("position")
    if kind == "discrete":
        first_seen = F.min("position").over(Window.partitionBy("signature"))
        numbered = signatures.withColumn("_first", first_seen)
        block = F.dense_rank().over(whole.orderBy("_first")) - 1
        return numbered.select("field", "position", block.cast("long").alias("block"))
    if kind == "continuous":
        changed = F.coalesce(F.lag("signature").over(in_order) != F.col("signature"), F.lit(False)).cast("int")
        marked = signatures.withColumn("_changed", changed)
        block = F.sum("_changed").over(in_order)
        return marked.select("field", "position", block.cast("long").alias("block"))
    raise ValueError("kind must be 'discrete' or 'continuous'")


def column_block_rows(
    df: DataFrame, column_block_table: DataFrame, index: str, label: str = "label"
) -> tuple[DataFrame, dict[int, list[str]]]:
    """((block, index, label, values) of every column block, the columns of each block).

    A row goes to the blocks whose columns it has, with its values there, so that one pass gives all blocks; the result is
    stored with a folder per block.
    """
    members: dict[int, list[str]] = {}
    for row in column_block_table.orderBy("position").collect():  # one row per column
        members.setdefault(row["block"], []).append(row["field"])
    parts = [
        F.when(
            c(names[0]).isNotNull(),
            F.struct(F.lit(block).alias("block"), F.array(*[c(n).cast("string") for n in names]).alias("values")),
        )
        for block, names in sorted(members.items())
    ]
    found = df.select(c(index).alias("index"), c(label).alias("label"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    rows = found.select("index", "label", "p.values", F.col("p.block").cast("long").alias("block"))
    return stored(rows, "column-blocks", ["block"]), members


def column_block_slices(
    df: DataFrame, column_block_table: DataFrame, index: str, label: str = "label"
) -> dict[int, DataFrame]:
    """Per column block its rows (those where its columns are set): index first, the block's columns, label last.

    All blocks are written in one pass over the table; a slice reads its own folder.
    """
    rows, members = column_block_rows(df, column_block_table, index, label)
    slices = {}
    for block, names in members.items():
        kinds = {name: df.schema[name].dataType for name in names}
        values = {name: F.col("values")[k].cast(kinds[name]).alias(name) for k, name in enumerate(names)}
        ends = {index: F.col("index").alias(index), label: F.col("label").alias(label)}
        order = dict.fromkeys([index, *names, label])
        slices[block] = rows.filter(F.col("block") == block).select(*[ends.get(n, values.get(n)) for n in order])
    return slices


def pad_or_truncate(
    df: DataFrame,
    pad: bool,
    index: str,
    kind: str = "continuous",
    label: str = "label",
    segments: str = "tcp.reassembled_segments",
    pad_value: str = "ffff",
) -> list[DataFrame]:
    """Drop all-null columns and code the segment lists; then pad the nulls, or cut the table into column blocks."""
    kept = drop_all_null_columns(df)
    if segments in kept.columns:
        coded = integer_code(kept, segments, index, out="_segments")
        kept = coded.select(
            *[F.col("_segments").cast("string").alias(n) if n == segments else c(n) for n in kept.columns]
        )
    if pad:
        return [pad_nulls(kept, pad_value)]
    signatures = column_signatures(kept, kept.columns, index)
    slices = column_block_slices(kept, column_blocks(signatures, kind), index, label)
    return [slices[block] for block in sorted(slices)]


# -- summaries --------------------------------------------------------------------------------------------------


def label_block_counts(df: DataFrame) -> DataFrame:
    """(label, block_id, n) of the pairs that occur: the matrix in long form, for any number of blocks."""
    return df.groupBy("label", "block_id").agg(F.count(F.lit(1)).alias("n"))


def label_block_matrix(df: DataFrame, block_ids: Sequence[int]) -> DataFrame:
    """Label x block row counts, zero filled, with a column for each of the given blocks."""
    return df.groupBy("label").pivot("block_id", list(block_ids)).count().na.fill(0).orderBy("label")


def matrix_lines(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, cells): a line per row with its values in column order, joined by commas; a cell that is missing is 0.

    Any number of columns fits, since none becomes a column of the table.
    """
    columns = cells.select(c(column).alias("_column")).distinct().agg(F.array_sort(F.collect_list("_column"))).scalar()
    rows = cells.select(c(row).alias("_row")).distinct().withColumn("_columns", columns)
    zeros = rows.select("_row", F.explode("_columns").alias("_column"), F.lit(0).cast("long").alias("_n"))
    given = cells.select(c(row).alias("_row"), c(column).alias("_column"), c(value).cast("long").alias("_n"))
    full = given.unionByName(zeros).groupBy("_row", "_column").agg(F.sum("_n").alias("_n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("_column", "_n"))), lambda p: p["_n"].cast("string"))
    return full.groupBy("_row").agg(F.concat_ws(",", line).alias("cells")).select(F.col("_row").alias(row), "cells")


def feature_block_matrix(blocks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, block_id, present) for all fields seen in any block."""
    every = F.array(*[F.lit(n) for n in fields])
    return blocks.select("block_id", "schema", F.explode(every).alias("field")).select(
        "field", "block_id", F.array_contains("schema", F.col("field")).cast("int").alias("present")
    )


def top_fields(blocks: DataFrame, k: int = 10) -> DataFrame:
    """The k fields found in most blocks, ties by name."""
    return (
        blocks.select(F.explode("schema").alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_blocks"))
        .orderBy(F.desc("n_blocks"), "field")
        .limit(k)
    )


# -- similarity and merge plans ---------------------------------------------------------------------------------


def item_frequency(core: DataFrame, items: str) -> DataFrame:
    """(_item, _f): in how many core blocks an item is."""
    return core.select(F.explode(items).alias("_item")).groupBy("_item").agg(F.count(F.lit(1)).alias("_f"))


def rare_first(blocks: DataFrame, frequency: DataFrame, items: str) -> DataFrame:
    """Add `_ranked`: the block's items ordered from rare to frequent among the core blocks, ties by name."""
    exploded = blocks.select("block_id", F.explode(items).alias("_item"))
    ranked = (
        exploded.join(frequency, "_item", "left")
        .groupBy("block_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "_item"))).alias("_s"))
        .select("block_id", F.transform("_s", lambda s: s["_item"]).alias("_ranked"))
    )
    return blocks.join(ranked, "block_id", "left").withColumn("_ranked", F.coalesce("_ranked", F.array().cast("array<string>")))


def _prefix(ranked: DataFrame, threshold: float, block: str, size: str, place: str) -> DataFrame:
    """(block, size, place, _item): a block's rarest items, one of which any similar block shares."""
    here = F.size("_ranked")
    need = F.ceil(F.lit(float(threshold)) * here - F.lit(1e-9))
    length = F.greatest(F.lit(1), here - need + 1).cast("int")
    return ranked.select(
        F.col("block_id").alias(block), here.alias(size), F.posexplode(F.slice("_ranked", F.lit(1), length)).alias(place, "_item")
    )


def candidate_pairs(
    small: DataFrame, core: DataFrame, items: str, threshold: float, supersets: bool = False
) -> DataFrame:
    """(block_id, core_id) pairs that can reach a Jaccard of `threshold` on `items`.

    Items are ordered from rare to frequent. A pair at or above the threshold shares at least ceil(threshold * |items|)
    items of either side, so it shares one of the rarest |items| - that + 1 of both: only these are joined, where the sizes
    allow the threshold. The place of a pair's first shared item bounds what it can share at all: no more than what is left
    from there on in either list. `supersets` also gives every core block that may hold all items: these hold the rarest.
    """
    frequency = item_frequency(core, items)
    left, right = rare_first(small, frequency, items), rare_first(core, frequency, items)
    probes = _prefix(left, threshold, "block_id", "_here", "_at")
    index = _prefix(right, threshold, "core_id", "_there", "_place")
    here, there = F.col("_here"), F.col("_there")
    fits = F.least(here, there) >= F.greatest(here, there) * F.lit(float(threshold)) - F.lit(1e-9)
    met = probes.join(index, "_item").filter(fits).groupBy("block_id", "core_id", "_here", "_there")
    # both lists have one order, so the first shared item has the least place in both
    first = met.agg(F.min("_at").alias("_at"), F.min("_place").alias("_place"))
    most = F.least(here - F.col("_at"), there - F.col("_place"))
    need = F.lit(threshold / (1.0 + threshold)) * (here + there) - F.lit(1e-9)
    pairs = first.filter(most >= need).select("block_id", "core_id")
    if not supersets:
        return pairs
    rarest = left.filter(F.size("_ranked") > 0).select("block_id", F.size("_ranked").alias("_here"), F.col("_ranked")[0].alias("_item"))
    holders = core.select(F.col("block_id").alias("core_id"), F.size(items).alias("_there"), F.explode(items).alias("_item"))
    above = rarest.join(holders, "_item").filter(there >= here).select("block_id", "core_id")
    return pairs.unionByName(above).distinct()


def similar_blocks(small: DataFrame, core: DataFrame, threshold: float) -> DataFrame:
    """Field Jaccard of small/core pairs that reach `threshold` or where the core holds all fields."""
    left = small.select("block_id", "schema")
    smallest = core.orderBy(F.size("schema"), "block_id").limit(1).select("block_id").scalar()
    no_fields = left.filter(F.size("schema") == 0).select("block_id", smallest.alias("core_id"))
    pairs = candidate_pairs(left, core, "schema", threshold, supersets=True).union(
        no_fields.filter(F.col("core_id").isNotNull())
    )
    right = core.select(F.col("block_id").alias("core_id"), F.col("schema").alias("core_schema"))
    scored = pairs.join(left.select("block_id", "schema"), "block_id").join(right, "core_id")
    excess = F.size(F.array_except("core_schema", "schema"))
    inside = F.size(F.array_except("schema", "core_schema")) == 0
    return scored.select(
        "block_id",
        "core_id",
        jaccard(F.col("schema"), F.col("core_schema")).alias("similarity"),
        inside.alias("is_superset"),
        excess.cast("long").alias("excess"),
    ).filter(F.col("is_superset") | (F.col("similarity") >= threshold))


def split_core(blocks: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    return blocks.filter(F.col("n_rows") >= min_rows), blocks.filter(F.col("n_rows") < min_rows)


def _best(scored: DataFrame, order: Sequence[Column]) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("block_id").orderBy(*order))
    return scored.withColumn("_r", best).filter(F.col("_r") == 1).drop("_r")


def _plan(blocks: DataFrame, min_rows: int, chosen: DataFrame) -> DataFrame:
    """(block_id, role, target_id, similarity) for every block."""
    joined = blocks.join(chosen, "block_id", "left")
    core = F.col("n_rows") >= min_rows
    return joined.select(
        "block_id",
        F.when(core, F.lit("core")).when(F.col("core_id").isNull(), F.lit("orphan")).otherwise(F.lit("merged")).alias(
            "role"
        ),
        F.when(core, F.col("block_id")).otherwise(F.col("core_id")).alias("target_id"),
        F.when(~core, F.col("similarity")).alias("similarity"),
    )


def merge_plan_jaccard(blocks: DataFrame, min_rows: int = 1000, threshold: float = 0.5) -> DataFrame:
    """Small block -> tightest core superset, else the most similar core at or above the threshold, else orphan."""
    core, small = split_core(blocks, min_rows)
    scored = similar_blocks(small, core, threshold)
    order = [
        F.desc("is_superset"),
        F.when(F.col("is_superset"), F.col("excess")).asc(),
        F.desc("similarity"),
        F.asc("core_id"),
    ]
    return _plan(blocks, min_rows, _best(scored, order).select("block_id", "core_id", "similarity"))


def with_trees(blocks: DataFrame) -> DataFrame:
    """Add `nodes` and `edges` arrays of the block's dotted tree."""
    pairs = dotted_edges(F.col("schema"))
    tree = blocks.withColumn("_pairs", pairs)
    ends = F.flatten(F.transform("_pairs", lambda e: F.array(e["parent"], e["child"])))
    return tree.select(
        *blocks.columns,
        F.array_distinct(ends).alias("nodes"),
        F.array_distinct(F.transform("_pairs", lambda e: F.concat(e["parent"], F.lit(">"), e["child"]))).alias("edges"),
    )


def tree_similarity(small: DataFrame, core: DataFrame, threshold: float, alpha: float = 0.5) -> DataFrame:
    """alpha * Jaccard(nodes) + (1 - alpha) * Jaccard(edges) for pairs that reach `threshold`.

    The weighted mean can only reach the threshold if one of its two parts does, so candidates come from both.
    """
    left, right = with_trees(small), with_trees(core)
    pairs = None
    for items in ("nodes", "edges"):
        found = candidate_pairs(left, right, items, threshold)
        pairs = found if pairs is None else pairs.union(found)
    scored = (
        pairs.distinct()
        .join(left.select("block_id", "nodes", "edges"), "block_id")
        .join(
            right.select(
                F.col("block_id").alias("core_id"),
                F.col("nodes").alias("core_nodes"),
                F.col("edges").alias("core_edges"),
            ),
            "core_id",
        )
    )
    node_part = jaccard(F.col("nodes"), F.col("core_nodes"))
    edge_part = jaccard(F.col("edges"), F.col("core_edges"))
    return scored.select(
        "block_id",
        "core_id",
        (F.lit(alpha) * node_part + F.lit(1 - alpha) * edge_part).alias("similarity"),
        node_part.alias("node_similarity"),
        edge_part.alias("edge_similarity"),
    ).filter(F.col("similarity") >= threshold)


def merge_plan_tree(blocks: DataFrame, min_rows: int = 1000, threshold: float = 0.7) -> DataFrame:
    """Small block -> core block with the most similar tree at or above the threshold, else orphan."""
    core, small = split_core(blocks, min_rows)
    scored = tree_similarity(small, core, threshold)
    best = _best(scored, [F.desc("similarity"), F.asc("core_id")])
    return _plan(blocks, min_rows, best.select("block_id", "core_id", "similarity"))


def merge_log(plan: DataFrame, with_similarity: bool = False) -> DataFrame:
    """(block_id, message) per block."""
    merged = F.concat(F.lit("Merged into "), F.col("target_id").cast("string"))
    orphan = F.lit("Orphaned")
    if with_similarity:
        merged = F.concat(merged, F.lit(" (Similarity: "), F.format_string("%.4f", "similarity"), F.lit(")"))
        orphan = F.lit("Orphaned (Low similarity to all cores)")
    message = (
        F.when(F.col("role") == "core", F.lit("Core expert")).when(F.col("role") == "merged", merged).otherwise(orphan)
    )
    return plan.select("block_id", message.alias("message"))


def apply_merge(df: DataFrame, fields: Sequence[str], blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows relabelled to `expert`: fields of the target schema, '0' where the row lacks them, others null.

    Orphans go to `default_expert`, whose schema is the union of the orphans' fields.
    """
    schemas = blocks.select(F.col("block_id").alias("target_id"), F.col("schema").alias("target_schema"))
    orphans = plan.filter(F.col("role") == "orphan").join(blocks.select("block_id", "schema"), "block_id")
    orphan_schema = orphans.select(F.explode("schema").alias("field")).agg(F.collect_set("field").alias("s")).scalar()
    targets = plan.join(schemas, "target_id", "left").select(
        "block_id",
        F.coalesce(F.col("target_id").cast("string"), F.lit(DEFAULT_EXPERT)).alias("expert"),
        F.coalesce("target_schema", orphan_schema).alias("target_schema"),
    )
    joined = df.join(small_side(targets), "block_id")
    filled = [
        F.when(F.array_contains("target_schema", name), F.coalesce(c(name), F.lit("0"))).alias(name) for name in fields
    ]
    others = [c(name) for name in df.columns if name not in set(fields)]
    return joined.select(*others, "expert", *filled)


# -- main-block augmentation and specialist sets ----------------------------------------------------------------


def target_classes(df: DataFrame, main_blocks: Column, min_samples: int = 3000) -> DataFrame:
    """(label, n_main): labels below the threshold in the main block(s), absent ones with 0."""
    in_main = F.count_if(main_blocks)
    return df.groupBy("label").agg(in_main.alias("n_main")).filter(F.col("n_main") < min_samples)


def block_fields(blocks: DataFrame, ids: Sequence[int]) -> set[str]:
    """Fields of the given blocks."""
    rows = blocks.filter(F.col("block_id").isin(list(ids))).select(F.explode("schema").alias("field")).distinct()
    return {row["field"] for row in rows.collect()}  # at most the table's columns


def augment_main(
    df: DataFrame, fields: Sequence[str], blocks: DataFrame, main: Sequence[int], min_samples: int = 3000
) -> DataFrame:
    """Main rows plus the target classes' rows of every other block, on the main schema, '0' where missing."""
    schema = [name for name in fields if name in block_fields(blocks, main)]
    is_main = F.col("block_id").isin(list(main))
    targets = target_classes(df, is_main, min_samples).select("label", F.lit(True).alias("_target"))
    others = [c(name) for name in df.columns if name not in set(fields)]
    padded = [F.coalesce(c(name), F.lit("0")).alias(name) for name in schema]
    return (
        df.join(small_side(targets), "label", "left")
        .filter(is_main | F.col("_target"))
        .select(*others, *padded)
    )


def largest_blocks(blocks: DataFrame, k: int = 1) -> list[int]:
    """Ids of the k blocks with most bytes, ties by id."""
    top = blocks.orderBy(F.desc("n_bytes"), "block_id").limit(k).select("block_id")
    return [row["block_id"] for row in top.collect()]


def augment_auto(df: DataFrame, fields: Sequence[str], blocks: DataFrame, min_samples: int = 3000) -> DataFrame:
    return augment_main(df, fields, blocks, largest_blocks(blocks, 1), min_samples)


def augment_top_k(
    df: DataFrame, fields: Sequence[str], blocks: DataFrame, k: int = 3, min_samples: int = 3000
) -> DataFrame:
    return augment_main(df, fields, blocks, largest_blocks(blocks, k), min_samples)


def field_counts(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, n): non-null counts per column, one counter per column."""
    counted = df.groupBy(*keys).agg(*[F.count(c(name)).alias(name) for name in fields])
    return wide_to_long(counted, fields, "field", "n")


def top_n_features(df: DataFrame, fields: Sequence[str], n: int, existing: Sequence[str]) -> DataFrame:
    """The n most often set fields outside the existing schema, ties by name."""
    wanted = [name for name in fields if name not in set(existing)]
    return field_counts(df, wanted).filter(F.col("n") > 0).orderBy(F.desc("n"), "field").limit(n)


def grow_schema(
    df: DataFrame, fields: Sequence[str], blocks: DataFrame, main: int, min_samples: int = 2000
) -> tuple[list[str], list[str]]:
    """The main schema grown class by class, and the target classes in processing order.

    Rare classes come first (most frequent first), then classes absent from the main block (by name). Each adds its
    one (rare) or two (absent) most common new fields. Only the small (label, field, count) table reaches the driver.
    """
    is_main = F.col("block_id") == main
    targets = target_classes(df, is_main, min_samples)
    rows = targets.orderBy(F.desc("n_main"), "label").collect()
    donors = df.filter(~is_main).join(small_side(targets.select("label")), "label", "left_semi")
    counts: dict[str, list[tuple[int, str]]] = {}
    for row in field_counts(donors, fields, ["label"]).filter(F.col("n") > 0).collect():
        counts.setdefault(row["label"], []).append((-row["n"], row["field"]))
    schema = block_fields(blocks, [main])
    for row in rows:
        fresh = [field for _, field in sorted(counts.get(row["label"], [])) if field not in schema]
        schema.update(fresh[: 2 if row["n_main"] == 0 else 1])
    return [name for name in fields if name in schema], [row["label"] for row in rows]


def augment_with_features(
    df: DataFrame, fields: Sequence[str], blocks: DataFrame, main: int, min_samples: int = 2000
) -> DataFrame:
    """Main rows plus the target classes' rows of other blocks on the grown schema, nulls '0'."""
    schema, classes = grow_schema(df, fields, blocks, main, min_samples)
    others = [c(name) for name in df.columns if name not in set(fields)]
    keep = (F.col("block_id") == main) | F.col("label").isin(classes)
    return df.filter(keep).select(*others, *[F.coalesce(c(name), F.lit("0")).alias(name) for name in schema])


def specialist_set(
    df: DataFrame,
    fields: Sequence[str],
    blocks: DataFrame,
    chief: int,
    classes: Sequence[str],
    common: bool = False,
) -> DataFrame:
    """Rows of the classes on the fields the chief block lacks, nulls '0'.

    `common` keeps only fields that every block holding such rows has.
    """
    rows = df.filter(F.col("label").isin(list(classes)))
    donors = rows.select("block_id").distinct().join(blocks.select("block_id", "schema"), "block_id")
    spread = donors.select("block_id", F.explode("schema").alias("field")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = spread.filter(F.col("n") == donors.agg(F.count(F.lit(1)).alias("n")).scalar()) if common else spread
    found = {row["field"] for row in wanted.collect()} - block_fields(blocks, [chief])
    exclusive = [name for name in fields if name in found]
    others = [c(name) for name in df.columns if name not in set(fields)]
    return rows.select(*others, *[F.coalesce(c(name), F.lit("0")).alias(name) for name in exclusive])

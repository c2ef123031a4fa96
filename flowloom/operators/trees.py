"""Trees and graphs over dotted field names.

Trees are edge tables (group, parent, child); `group` tells trees apart, for example one per block. A layer without
children is a row with a null child. A group holds at most the columns of one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "root"
STATISTICS = "statistics"


def dotted_edges(fields: Column) -> Column:
    """All (parent, child) prefix pairs of an array of dotted names."""

    def of_field(field: Column) -> Column:
        parts = F.split(field, r"\.")
        depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            depths,
            lambda d: F.struct(
                F.array_join(F.slice(parts, F.lit(1), d), ".").alias("parent"),
                F.array_join(F.slice(parts, F.lit(1), d + 1), ".").alias("child"),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(fields, of_field)))


def per_group(fields: DataFrame, group: str) -> DataFrame:
    """(group, fields) with the group's field names as a sorted array (bounded by the table's columns)."""
    return fields.groupBy(group).agg(F.sort_array(F.collect_set("field")).alias("fields"))


def dotted_tree(fields: DataFrame, group: str) -> DataFrame:
    """Every dotted prefix is a parent of the next one."""
    return per_group(fields, group).select(group, F.explode(dotted_edges(F.col("fields"))).alias("e")).select(
        group, "e.*"
    )


def dotted_nodes(fields: DataFrame, group: str) -> DataFrame:
    """All fields and the abstract prefixes they imply."""
    edges = dotted_tree(fields, group)
    return fields.select(group, F.col("field").alias("node")).union(edges.select(group, F.col("parent"))).distinct()


def _with_layers(fields: DataFrame, group: str, layers: Sequence[str] | None) -> DataFrame:
    grouped = per_group(fields, group)
    inferred = F.array_distinct(F.transform("fields", lambda f: F.substring_index(f, ".", 1)))
    return grouped.withColumn("layers", inferred if layers is None else F.array(*[F.lit(x) for x in layers]))


def protocol_tree(
    fields: DataFrame, group: str, layers: Sequence[str] | None = None, logical: bool = True
) -> DataFrame:
    """Layer tree of each group's fields.

    `logical` adds the implied intermediate nodes. Otherwise only fields of the table become children: a layer's
    children are its two-part fields, or its three-part fields if it has none, and deeper fields hang on fields
    already reached. A one-part field outside the layers falls under `statistics`.
    """
    base = _with_layers(fields, group, layers)
    deep = F.exists("fields", lambda f: F.size(F.split(f, r"\.")) > 1)
    loose = F.filter("fields", lambda f: ~f.contains(".") & ~F.array_contains("layers", f))
    statistics = F.when(
        deep, F.transform(loose, lambda f: F.struct(F.lit(STATISTICS).alias("parent"), f.alias("child")))
    ).otherwise(F.array().cast("array<struct<parent:string,child:string>>"))
    edges = dotted_edges(F.col("fields")) if logical else _physical_edges()
    built = base.withColumn("edges", F.array_union(edges, statistics))
    bare = F.filter("layers", lambda layer: ~F.exists("edges", lambda e: e["parent"] == layer))
    empty = F.transform(bare, lambda x: F.struct(x.alias("parent"), F.lit(None).cast("string").alias("child")))
    return built.select(group, F.explode(F.array_union("edges", empty)).alias("e")).select(group, "e.*")


def _physical_edges() -> Column:
    def parts(f: Column) -> Column:
        return F.split(f, r"\.")

    def layer_of(f: Column) -> Column:
        return F.substring_index(f, ".", 1)

    def start_of(f: Column) -> Column:
        has_two = F.exists("fields", lambda g: (F.size(parts(g)) == 2) & (layer_of(g) == layer_of(f)))
        return F.when(has_two, F.lit(2)).otherwise(F.lit(3))

    def reached(f: Column) -> Column:
        start, size = start_of(f), F.size(parts(f))
        above = F.when(size > start, F.sequence(start, size - 1)).otherwise(F.array().cast("array<int>"))
        return (size >= start) & F.forall(
            above, lambda d: F.array_contains("fields", F.array_join(F.slice(parts(f), F.lit(1), d), "."))
        )

    def edge(f: Column) -> Column:
        size = F.size(parts(f))
        parent = F.when(size == start_of(f), layer_of(f)).otherwise(
            F.array_join(F.slice(parts(f), F.lit(1), size - 1), ".")
        )
        return F.struct(parent.alias("parent"), f.alias("child"))

    return F.transform(F.filter("fields", lambda f: reached(f) & F.array_contains("layers", layer_of(f))), edge)


def add_root(tree: DataFrame, group: str, mode: str = "protocol_only") -> DataFrame:
    """Edges from `root` to the parents that are nobody's child (only undotted ones in `protocol_only`)."""
    special = [ROOT, STATISTICS]
    parents = tree.select(group, F.col("parent").alias("node")).filter(~F.col("node").isin(special)).distinct()
    children = tree.select(group, F.col("child").alias("node")).filter(F.col("node").isNotNull()).distinct()
    top = parents.join(children, [group, "node"], "left_anti")
    if mode == "protocol_only":
        bare = ~F.col("node").contains(".")
        any_bare = F.max(bare).over(Window.partitionBy(group))
        top = top.withColumn("_any", any_bare).filter(bare | ~F.col("_any")).drop("_any")
    return tree.unionByName(top.select(group, F.lit(ROOT).alias("parent"), F.col("node").alias("child")))


def fields_with_subfields(tree: DataFrame, physical: DataFrame, group: str, protocol: str) -> DataFrame:
    """Children of a protocol: leaves, and fields with their physical subfields, flagged logical if implied."""
    names = physical.select(group, "field").distinct().withColumn("_physical", F.lit(True))
    kids = tree.filter((F.col("parent") == protocol) & F.col("child").isNotNull()).select(
        group, F.col("child").alias("field")
    )
    below = tree.filter(F.col("child").isNotNull()).join(
        names.select(group, F.col("field").alias("child"), "_physical"), [group, "child"], "left"
    )
    subs = below.groupBy(group, F.col("parent").alias("field")).agg(
        F.sort_array(F.collect_set(F.when(F.col("_physical"), F.col("child")))).alias("subfields")
    )
    joined = kids.join(names, [group, "field"], "left").join(subs, [group, "field"], "left")
    return joined.select(
        group,
        F.lit(protocol).alias("protocol"),
        "field",
        F.when(F.col("subfields").isNull(), F.lit("leaf")).otherwise(F.lit("with_subfields")).alias("kind"),
        F.col("_physical").isNull().alias("is_logical"),
        F.coalesce("subfields", F.array().cast("array<string>")).alias("subfields"),
    )


def tree_nodes(tree: DataFrame, group: str, extra: Sequence[str] = ()) -> DataFrame:
    """(group, node, node_id): position in the sorted node list without `statistics`."""
    ends = tree.select(group, F.explode(F.array("parent", "child", *[F.lit(x) for x in extra])).alias("node"))
    nodes = ends.filter(F.col("node").isNotNull() & (F.col("node") != STATISTICS)).distinct()
    order = Window.partitionBy(group).orderBy("node")
    return nodes.withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))


def tree_edges(tree: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(group, source, target): both directions of every edge as node ids."""
    numbered = (
        tree.filter(F.col("child").isNotNull())
        .join(nodes.select(group, F.col("node").alias("parent"), F.col("node_id").alias("p")), [group, "parent"])
        .join(nodes.select(group, F.col("node").alias("child"), F.col("node_id").alias("k")), [group, "child"])
    )
    both = F.array(
        F.struct(F.col("k").alias("source"), F.col("p").alias("target")),
        F.struct(F.col("p").alias("source"), F.col("k").alias("target")),
    )
    return numbered.select(group, F.explode(both).alias("e")).select(group, "e.*")


def virtual_sink_edges(nodes: DataFrame, group: str, sink: str) -> DataFrame:
    """Both directions between the sink node and every other node of its group."""
    sinks = nodes.filter(F.col("node") == sink).select(group, F.col("node_id").alias("s"))
    others = nodes.filter(F.col("node") != sink).join(sinks, group)
    both = F.array(
        F.struct(F.col("s").alias("source"), F.col("node_id").alias("target")),
        F.struct(F.col("node_id").alias("source"), F.col("s").alias("target")),
    )
    return others.select(group, F.explode(both).alias("e")).select(group, "e.*")


def batched_edges(edges: DataFrame, nodes: DataFrame, group: str, batch: int) -> DataFrame:
    """Edges repeated for each graph of a batch, node ids shifted by graph * node count."""
    sizes = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    graphs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch - 1).cast("long")))
    return (
        edges.join(sizes, group)
        .withColumn("graph", graphs)
        .select(
            group,
            "graph",
            (F.col("source") + F.col("graph") * F.col("_n")).alias("source"),
            (F.col("target") + F.col("graph") * F.col("_n")).alias("target"),
        )
    )

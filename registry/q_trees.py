"""Queries for trees and graphs over the field names found in each block of packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.scalars import strip_prefix as strip
from flowloom.operators import trees
from registry.core import query
from registry.fixtures import FIELDS, packets
from registry.q_blocks import blocks as block_ops
from registry.q_blocks import views

G = "block_id"
LAYERS = ["eth", "ip", "tcp", "tls"]
LOOSE = "stream_id"
SINK = "__VIRTUAL_SINK__"


def observed(spark, sf_dir):
    """(block_id, field) for the fields set in each block, and one field outside all layers."""
    table = block_ops.block_table(packets(spark, sf_dir), FIELDS)
    return table.select(G, F.explode(F.array_append("schema", F.lit(LOOSE))).alias("field"))


_LAYER_LIST = "[" + ", ".join(repr(x) for x in LAYERS) + "]"
TREE = {
    "f": f"select block_id, unnest(schema || ['{LOOSE}']) as field from b",
    "fp2": "select block_id, field, string_split(field, '.') as parts from f",
    "dt": """select distinct block_id, array_to_string(parts[1:d], '.') as parent, array_to_string(parts[1:d + 1], '.')
      as child from (select *, unnest(range(1, len(parts))) as d from fp2)""",
    "st": f"""select block_id, 'statistics' as parent, field as child from f
      where not contains(field, '.') and not list_contains({_LAYER_LIST}, field)""",
}


def with_empty(edges: str) -> str:
    return (
        f"select * from {edges} union all select b.block_id, l.layer, null from b cross join "
        f"(select unnest({_LAYER_LIST}) as layer) l where not exists "
        f"(select 1 from {edges} x where x.block_id = b.block_id and x.parent = l.layer)"
    )


LOGICAL = {**TREE, "le": "select * from dt union select * from st", "pt": with_empty("le")}
PHYSICAL = {
    **TREE,
    "s": """select *, case when exists (select 1 from fp2 y where y.block_id = fp2.block_id and len(y.parts) = 2
      and y.parts[1] = fp2.parts[1]) then 2 else 3 end as start from fp2""",
    "pe": f"""select block_id, case when len(parts) = start then parts[1]
        else array_to_string(parts[1:len(parts) - 1], '.') end as parent, field as child
      from s where len(parts) >= start and list_contains({_LAYER_LIST}, parts[1]) and not exists (
        select 1 from (select unnest(range(s.start, len(s.parts))) as d) dd
        where array_to_string(s.parts[1:dd.d], '.') not in (select field from f where f.block_id = s.block_id))""",
    "le": "select * from pe union select * from st",
    "pt": with_empty("le"),
}
ROOTED = {
    **LOGICAL,
    "top": """select distinct block_id, parent from pt where parent <> 'statistics' and not exists
      (select 1 from pt x where x.block_id = pt.block_id and x.child = pt.parent)""",
    "rt": "select * from pt union all select block_id, 'root', parent from top where not contains(parent, '.')",
    "nd": """select block_id, node, row_number() over (partition by block_id order by node) - 1 as node_id from
      (select block_id, parent as node from rt where parent <> 'statistics' union
       select block_id, child from rt where child is not null
       union select block_id, '__VIRTUAL_SINK__' from b)""",
    "ed": """select rt.block_id, c.node_id as source, p.node_id as target from rt join nd p on p.block_id = rt.block_id
      and p.node = rt.parent join nd c on c.block_id = rt.block_id and c.node = rt.child
      union all select rt.block_id, p.node_id, c.node_id from rt join nd p on p.block_id = rt.block_id
      and p.node = rt.parent join nd c on c.block_id = rt.block_id and c.node = rt.child""",
}


def rooted(spark, sf_dir):
    return trees.add_root(trees.protocol_tree(observed(spark, sf_dir), G, LAYERS), G)


def graph(spark, sf_dir):
    tree = rooted(spark, sf_dir)
    return tree, trees.tree_nodes(tree, G, extra=[SINK])


@query("dotted_tree", views("select block_id, parent, child from dt", **TREE))
def dotted_tree(spark, sf_dir):
    return trees.dotted_tree(observed(spark, sf_dir), G)


@query(
    "dotted_nodes", views("select block_id, field as node from f union select block_id, parent from dt", **TREE)
)
def dotted_nodes(spark, sf_dir):
    return trees.dotted_nodes(observed(spark, sf_dir), G)


@query("protocol_tree", views("select block_id, parent, child from pt", **LOGICAL))
def protocol_tree(spark, sf_dir):
    return trees.protocol_tree(observed(spark, sf_dir), G, LAYERS)


@query("protocol_tree_physical", views("select block_id, parent, child from pt", **PHYSICAL))
def protocol_tree_physical(spark, sf_dir):
    return trees.protocol_tree(observed(spark, sf_dir), G, LAYERS, logical=False)


@query("tree_root", views("select block_id, parent, child from rt where parent = 'root'", **ROOTED))
def tree_root(spark, sf_dir):
    return rooted(spark, sf_dir).filter(F.col("parent") == trees.ROOT)


@query(
    "field_subfields",
    views(
        """select k.block_id, k.parent as protocol, k.child as field,
          case when t.parent is null then 'leaf' else 'with_subfields' end as kind,
          case when p.field is null then 1 else 0 end as is_logical, coalesce(t.subs, '') as subfields
        from le k left join f p on p.block_id = k.block_id and p.field = k.child
        left join (select le.block_id, le.parent, coalesce(string_agg(le.child, ',' order by le.child)
            filter (where f.field is not null), '') as subs
          from le left join f on f.block_id = le.block_id and f.field = le.child group by 1, 2) t
          on t.block_id = k.block_id and t.parent = k.child
        where k.parent in ('ip', 'tls')""",
        **LOGICAL,
    ),
)
def field_subfields(spark, sf_dir):
    fields = observed(spark, sf_dir)
    tree = trees.protocol_tree(fields, G, LAYERS)
    found = trees.fields_with_subfields(tree, fields, G, "ip").union(
        trees.fields_with_subfields(tree, fields, G, "tls")
    )
    return found.withColumn("is_logical", F.col("is_logical").cast("int")).withColumn(
        "subfields", F.array_join("subfields", ",")
    )


@query("tree_edges", views("select block_id, source, target from ed", **ROOTED))
def tree_edges(spark, sf_dir):
    tree, nodes = graph(spark, sf_dir)
    return trees.tree_edges(tree, nodes, G)


@query(
    "sink_edges",
    views(
        f"""select n.block_id, s.node_id as source, n.node_id as target from nd n join nd s
          on s.block_id = n.block_id and s.node = '{SINK}' and n.node <> '{SINK}'
        union all select n.block_id, n.node_id, s.node_id from nd n join nd s
          on s.block_id = n.block_id and s.node = '{SINK}' and n.node <> '{SINK}'""",
        **ROOTED,
    ),
)
def sink_edges(spark, sf_dir):
    _, nodes = graph(spark, sf_dir)
    return trees.virtual_sink_edges(nodes, G, SINK)


@query(
    "batched_edges",
    views(
        """select ed.block_id, g.graph, source + g.graph * n.c as source, target + g.graph * n.c as target
        from ed join (select block_id, count(*) as c from nd group by 1) n using (block_id)
        cross join (select unnest(range(0, 4)) as graph) g""",
        **ROOTED,
    ),
)
def batched_edges(spark, sf_dir):
    tree, nodes = graph(spark, sf_dir)
    return trees.batched_edges(trees.tree_edges(tree, nodes, G), nodes, G, 4)


@query(
    "strip_prefix",
    views(
        "select block_id, field, lower(translate(case when starts_with(field, 'tcp.') then substr(field, 5) "
        "else field end, '.-', '__')) as stripped from f",
        **TREE,
    ),
)
def strip_prefix(spark, sf_dir):
    return observed(spark, sf_dir).withColumn("stripped", strip(F.col("field"), "tcp."))

"""Queries for field-presence blocks, their merging and main-block augmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from flowloom.operators import blocks
from flowloom.scale import c
from registry.core import query
from registry.fixtures import FIELDS, packets, table, with_views

# thresholds grow with the table, so that small blocks and rare labels exist at every size
MIN_ROWS = "(select count(*) // 50 from events)"
FEW = "(select count(*) * 3 // 100 from events)"

_FP = "concat_ws('|', " + ", ".join(f"case when \"{n}\" is not null then '{n}' end" for n in FIELDS) + ")"
_BYTES = " + ".join(f'coalesce(length("{n}"), 0)' for n in FIELDS)
VIEWS = {
    "fp": f"select *, {_FP} as fingerprint from packets",
    "b": f"""select row_number() over (order by fingerprint) - 1 as block_id, fingerprint, count(*) as n_rows,
      sum({_BYTES})::bigint as n_bytes, string_split(fingerprint, '|') as schema from fp group by fingerprint""",
    "r": "select fp.*, b.block_id from fp join b using (fingerprint)",
}


def views(sql: str, **extra: str) -> str:
    return with_views(sql, "packets", **VIEWS, **extra)


def min_rows(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").count() // 50


def few(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").count() * 3 // 100


def block_rows(spark, sf_dir):
    """(packets with block_id, block table)."""
    df = packets(spark, sf_dir)
    found = blocks.block_table(df, FIELDS)
    return blocks.assign_blocks(df, FIELDS, found), found


@query("fingerprint", with_views(f"select packet_id, {_FP} as fingerprint from packets", "packets"))
def fingerprint(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", blocks.fingerprint(FIELDS).alias("fingerprint"))


@query("block_assign", views("select packet_id, block_id from r"))
def block_assign(spark, sf_dir):
    return block_rows(spark, sf_dir)[0].select("packet_id", "block_id")


@query(
    "block_sizes",
    views("select block_id, md5(fingerprint) as fingerprint_md5, n_rows, n_bytes, len(schema) as n_fields from b"),
)
def block_sizes(spark, sf_dir):
    found = blocks.block_table(packets(spark, sf_dir), FIELDS)
    return found.select(
        "block_id", "fingerprint_md5", "n_rows", "n_bytes", F.size("schema").cast("long").alias("n_fields")
    )


@query("block_slice", views('select packet_id as "index", "ip.len", "tls.record.length", label from r where block_id = 0'))
def block_slice(spark, sf_dir):
    df, _ = block_rows(spark, sf_dir)
    return blocks.block_slice(df, 0, ["ip.len", "tls.record.length"], "packet_id")


# -- blocks of columns ------------------------------------------------------------------------------------------

# which rows a column covers, as an exact md5 over the sorted row ids
_SIGNATURES = " union all ".join(
    f"select {i} as position, '{n}' as field, coalesce(md5(string_agg(case when \"{n}\" is not null "
    "then packet_id::varchar end, ',' order by packet_id)), '') as sig from packets"
    for i, n in enumerate(FIELDS)
)


@query(
    "column_blocks_discrete",
    with_views(
        "select field, position::bigint as position, dense_rank() over (order by first) - 1 as block from "
        "(select *, min(position) over (partition by sig) as first from s)",
        "packets",
        s=_SIGNATURES,
    ),
)
def column_blocks_discrete(spark, sf_dir):
    return blocks.column_blocks(blocks.column_signatures(packets(spark, sf_dir), FIELDS, "packet_id"), "discrete")


@query(
    "column_blocks_continuous",
    with_views(
        "select field, position::bigint as position, sum(changed) over (order by position)::bigint as block from "
        "(select *, case when sig <> lag(sig) over (order by position) then 1 else 0 end as changed from s)",
        "packets",
        s=_SIGNATURES,
    ),
)
def column_blocks_continuous(spark, sf_dir):
    return blocks.column_blocks(blocks.column_signatures(packets(spark, sf_dir), FIELDS, "packet_id"), "continuous")


@query(
    "column_block_rows",
    with_views(
        "select block, string_agg(field, '|' order by position) as fields, any_value(n) as n_rows from (select "
        "field, position, sum(changed) over (order by position)::bigint as block, n from (select *, "
        "case when sig <> lag(sig) over (order by position) then 1 else 0 end as changed from s)) group by 1",
        "packets",
        s=" union all ".join(
            f"select {i} as position, '{n}' as field, coalesce(md5(string_agg(case when \"{n}\" is not null "
            f"then packet_id::varchar end, ',' order by packet_id)), '') as sig, count(\"{n}\") as n from packets"
            for i, n in enumerate(FIELDS)
        ),
    ),
)
def column_block_rows(spark, sf_dir):
    """Rows of each slice of the table by runs of columns with equal row sets."""
    df = packets(spark, sf_dir)
    table_of_blocks = blocks.column_blocks(blocks.column_signatures(df, FIELDS, "packet_id"), "continuous")
    counted = [
        part.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(block).cast("long").alias("block"),
            F.lit("|".join(n for n in part.columns if n in FIELDS)).alias("fields"),
            "n_rows",
        )
        for block, part in blocks.column_block_slices(df, table_of_blocks, "packet_id").items()
    ]
    return reduce(lambda a, b: a.union(b), counted)


#: Runs of adjacent columns of `packets` that are set in the same rows.
_TRUNCATED = [
    FIELDS[: FIELDS.index("tcp.options.mss_val")],
    ["tcp.options.mss_val"],
    ["tcp.options.timestamp"],
    ["tcp.srcport"],
    ["tcp.vendor.note"],
    ["tls.handshake.extension.type", "tls.handshake.type"],
    ["tls.record.content_type", "tls.record.length"],
]


@query(
    "pad_or_truncate",
    with_views(
        "select block, fields, packet_id, label, case block "
        + " ".join(
            f"when {k} then concat_ws('|', " + ", ".join(f'"{n}"' for n in names) + ")" for k, names in enumerate(_TRUNCATED)
        )
        + " end as values from packets cross join (values "
        + ", ".join(f"({k}::bigint, '{'|'.join(names)}')" for k, names in enumerate(_TRUNCATED))
        + ") v(block, fields) where case block "
        + " ".join(f'when {k} then "{names[0]}" is not null' for k, names in enumerate(_TRUNCATED))
        + " end",
        "packets",
    ),
)
def pad_or_truncate(spark, sf_dir):
    """The packets cut into blocks of adjacent columns with equal row sets, in long form, from one written table."""
    df = packets(spark, sf_dir).select("packet_id", "label", *[c(n) for n in FIELDS])
    parts = blocks.pad_or_truncate(df, False, "packet_id")
    found = []
    for part in parts:
        names = [n for n in part.columns if n in FIELDS]
        if names:
            found.append(
                part.select(
                    F.lit(len(found)).cast("long").alias("block"), F.lit("|".join(names)).alias("fields"), "packet_id", "label",
                    F.concat_ws("|", *[c(n) for n in names]).alias("values"),
                )
            )
    return reduce(lambda a, b: a.union(b), found)


# -- summaries --------------------------------------------------------------------------------------------------


@query(
    "label_block_matrix",
    views(
        "select label, string_agg(n::varchar, ',' order by block_id) as counts from (select l.label, b.block_id, "
        "count(r.packet_id) as n from (select distinct label from r) l cross join b left join r "
        "on r.label = l.label and r.block_id = b.block_id group by 1, 2) group by label"
    ),
)
def label_block_matrix(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    ids = [row["block_id"] for row in found.orderBy("block_id").select("block_id").collect()]  # one row per block
    matrix = blocks.label_block_matrix(df, ids)
    return matrix.select("label", F.concat_ws(",", *[c(str(n)).cast("string") for n in ids]).alias("counts"))


@query("label_block_counts", views("select label, block_id, count(*) as n from r group by 1, 2"))
def label_block_counts(spark, sf_dir):
    return blocks.label_block_counts(block_rows(spark, sf_dir)[0])


@query(
    "feature_block_matrix",
    views(
        "select f.field, b.block_id, list_contains(b.schema, f.field)::int as present from b cross join "
        f"(select unnest([{', '.join(repr(n) for n in FIELDS)}]) as field) f"
    ),
)
def feature_block_matrix(spark, sf_dir):
    return blocks.feature_block_matrix(blocks.block_table(packets(spark, sf_dir), FIELDS), FIELDS)


@query(
    "label_block_lines",
    views(
        "select label, string_agg(n::varchar, ',' order by block_id) as cells from (select l.label, b.block_id, "
        "count(r.packet_id) as n from (select distinct label from r) l cross join b left join r "
        "on r.label = l.label and r.block_id = b.block_id group by 1, 2) group by label"
    ),
)
def label_block_lines(spark, sf_dir):
    counts = blocks.label_block_counts(block_rows(spark, sf_dir)[0])
    return blocks.matrix_lines(counts, "label", "block_id", "n")


@query(
    "field_block_lines",
    views(
        "select field, string_agg(present::varchar, ',' order by block_id) as cells from (select f.field, b.block_id, "
        "list_contains(b.schema, f.field)::int as present from b cross join "
        f"(select unnest([{', '.join(repr(n) for n in FIELDS)}]) as field) f) group by 1"
    ),
)
def field_block_lines(spark, sf_dir):
    present = blocks.feature_block_matrix(blocks.block_table(packets(spark, sf_dir), FIELDS), FIELDS)
    return blocks.matrix_lines(present, "field", "block_id", "present")


@query(
    "top_fields",
    views(
        "select field, count(*) as n_blocks from (select unnest(schema) as field from b) group by 1 "
        "order by 2 desc, 1 limit 18"
    ),
)
def top_fields(spark, sf_dir):
    return blocks.top_fields(blocks.block_table(packets(spark, sf_dir), FIELDS), 18)


# -- merging ----------------------------------------------------------------------------------------------------

JACCARD, TREE = 0.89, 0.84
_SPLIT = {
    "small": f"select * from b where n_rows < {MIN_ROWS}",
    "core": f"select block_id as core_id, schema as core_schema from b where n_rows >= {MIN_ROWS}",
    "j": """select block_id, core_id, len(list_intersect(schema, core_schema)) /
        len(list_distinct(schema || core_schema))::double as similarity,
        len(list_intersect(schema, core_schema)) = len(schema) as is_superset,
        (len(core_schema) - len(list_intersect(schema, core_schema)))::bigint as excess from small cross join core""",
}
_EDGES = """select distinct block_id, array_to_string(parts[1:d], '.') as parent, array_to_string(parts[1:d + 1], '.')
    as child from (select block_id, parts, unnest(range(1, len(parts))) as d from
    (select block_id, string_split(unnest(schema), '.') as parts from b))"""
_TREES = {
    "e": _EDGES,
    "t": """select b.block_id, b.n_rows, n.nodes, e2.edges from b
      join (select block_id, list(distinct node) as nodes from
        (select block_id, parent as node from e union select block_id, child from e) group by 1) n using (block_id)
      join (select block_id, list(distinct parent || '>' || child) as edges from e group by 1) e2 using (block_id)""",
    "ts": f"""select s.block_id, k.block_id as core_id,
        len(list_intersect(s.nodes, k.nodes)) / len(list_distinct(s.nodes || k.nodes))::double as node_similarity,
        len(list_intersect(s.edges, k.edges)) / len(list_distinct(s.edges || k.edges))::double as edge_similarity
      from t s join t k on s.n_rows < {MIN_ROWS} and k.n_rows >= {MIN_ROWS}""",
    "tsim": f"""select *, 0.5::double * node_similarity + 0.5::double * edge_similarity as similarity from ts
      where 0.5::double * node_similarity + 0.5::double * edge_similarity >= {TREE}""",
}
_PLAN = """select b.block_id, case when n_rows >= {min} then 'core' when core_id is null then 'orphan' else 'merged' end
    as role, case when n_rows >= {min} then b.block_id else core_id end as target_id,
    case when n_rows < {min} then similarity end as similarity
  from b left join (select * from {best}) x on x.block_id = b.block_id"""
_BEST_J = f"""(select block_id, core_id, similarity from j where is_superset or similarity >= {JACCARD}
    qualify row_number() over (partition by block_id order by is_superset desc,
    case when is_superset then excess end nulls first, similarity desc, core_id) = 1)"""
_BEST_T = """(select block_id, core_id, similarity from tsim
    qualify row_number() over (partition by block_id order by similarity desc, core_id) = 1)"""
_PLAN_J = _PLAN.format(min=MIN_ROWS, best=_BEST_J)
_PLAN_T = _PLAN.format(min=MIN_ROWS, best=_BEST_T)
_ROUND_PLAN = "select block_id, role, target_id, round(similarity, 6) as similarity from plan"


def rounded(df, *names):
    return df.select(*[F.round(n, 6).alias(n) if n in names else n for n in df.columns])


@query(
    "block_jaccard",
    views(
        f"select block_id, core_id, round(similarity, 6) as similarity, is_superset, excess from j "
        f"where is_superset or similarity >= {JACCARD}",
        **_SPLIT,
    ),
)
def block_jaccard(spark, sf_dir):
    core, small = blocks.split_core(blocks.block_table(packets(spark, sf_dir), FIELDS), min_rows(spark, sf_dir))
    return rounded(blocks.similar_blocks(small, core, JACCARD), "similarity")


@query(
    "tree_similarity",
    views(
        "select block_id, core_id, round(similarity, 6) as similarity, round(node_similarity, 6) as node_similarity, "
        "round(edge_similarity, 6) as edge_similarity from tsim",
        **_TREES,
    ),
)
def tree_similarity(spark, sf_dir):
    core, small = blocks.split_core(blocks.block_table(packets(spark, sf_dir), FIELDS), min_rows(spark, sf_dir))
    return rounded(
        blocks.tree_similarity(small, core, TREE), "similarity", "node_similarity", "edge_similarity"
    )


@query("merge_plan_jaccard", views(_ROUND_PLAN, **_SPLIT, plan=_PLAN_J))
def merge_plan_jaccard(spark, sf_dir):
    found = blocks.block_table(packets(spark, sf_dir), FIELDS)
    return rounded(blocks.merge_plan_jaccard(found, min_rows(spark, sf_dir), JACCARD), "similarity")


@query("merge_plan_tree", views(_ROUND_PLAN, **_TREES, plan=_PLAN_T))
def merge_plan_tree(spark, sf_dir):
    found = blocks.block_table(packets(spark, sf_dir), FIELDS)
    return rounded(blocks.merge_plan_tree(found, min_rows(spark, sf_dir), TREE), "similarity")


@query(
    "merge_log",
    views(
        "select block_id, case role when 'core' then 'Core expert' when 'merged' then "
        "printf('Merged into %d (Similarity: %.4f)', target_id, similarity) "
        "else 'Orphaned (Low similarity to all cores)' end as message from plan",
        **_TREES,
        plan=_PLAN_T,
    ),
)
def merge_log(spark, sf_dir):
    found = blocks.block_table(packets(spark, sf_dir), FIELDS)
    return blocks.merge_log(blocks.merge_plan_tree(found, min_rows(spark, sf_dir), TREE), with_similarity=True)


@query(
    "apply_merge",
    views(
        "select r.packet_id, r.label, coalesce(x.target_id::varchar, 'default_expert') as expert, "
        + ", ".join(
            f"case when list_contains(coalesce(tb.schema, o.schema), '{n}') then coalesce(\"{n}\", '0') end as \"{n}\""
            for n in FIELDS
        )
        + " from r join plan x using (block_id) left join b tb on tb.block_id = x.target_id cross join o",
        **_SPLIT,
        plan=_PLAN_J,
        o="select list_distinct(flatten(list(schema))) as schema from b join plan using (block_id) "
        "where role = 'orphan'",
    ),
)
def apply_merge(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    plan = blocks.merge_plan_jaccard(found, min_rows(spark, sf_dir), JACCARD)
    merged = blocks.apply_merge(df, FIELDS, found, plan)
    return merged.select("packet_id", "label", "expert", *[c(n) for n in FIELDS])


# -- augmentation -----------------------------------------------------------------------------------------------


def packed(df):
    """Row identity and its padded field values as one text, so that the schema may depend on the data."""
    names = [n for n in FIELDS if n in df.columns]
    return df.select("packet_id", "label", "block_id", F.concat_ws("|", *[c(n) for n in names]).alias("values"))


def packed_sql(schema: str, condition: str) -> str:
    values = ", ".join(f"case when list_contains({schema}, '{n}') then coalesce(\"{n}\", '0') end" for n in FIELDS)
    return f"select packet_id, label, block_id, concat_ws('|', {values}) as values from r cross join m where {condition}"


def main_views(ids: str) -> dict[str, str]:
    return {
        "mi": ids,
        "m": "select list_distinct(flatten(list(schema))) as schema from b join mi using (block_id)",
        "mt": "select label, count(*) filter (where block_id in (select block_id from mi)) as n_main from r group by 1 "
        f"having count(*) filter (where block_id in (select block_id from mi)) < {FEW}",
    }


_IN_MAIN = "block_id in (select block_id from mi) or label in (select label from mt)"
_FIRST = "select 0 as block_id"
_TOP = "select block_id from b order by n_bytes desc, block_id limit {0}"


@query("target_classes", views("select label, n_main from mt", **main_views(_FIRST)))
def target_classes(spark, sf_dir):
    df, _ = block_rows(spark, sf_dir)
    return blocks.target_classes(df, F.col("block_id") == 0, few(spark, sf_dir))


@query("augment_main", views(packed_sql("m.schema", _IN_MAIN), **main_views(_FIRST)))
def augment_main(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.augment_main(df, FIELDS, found, [0], few(spark, sf_dir)))


@query("augment_auto", views(packed_sql("m.schema", _IN_MAIN), **main_views(_TOP.format(1))))
def augment_auto(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.augment_auto(df, FIELDS, found, few(spark, sf_dir)))


@query("augment_top_k", views(packed_sql("m.schema", _IN_MAIN), **main_views(_TOP.format(3))))
def augment_top_k(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.augment_top_k(df, FIELDS, found, 3, few(spark, sf_dir)))


_COUNTS = " union all ".join(
    f"select label, '{n}' as field, count(\"{n}\") as n from {{0}} group by label" for n in FIELDS
)


@query(
    "top_n_features",
    views(
        "select field, n from (select field, sum(n)::bigint as n from k group by 1) cross join m "
        "where n > 0 and not list_contains(m.schema, field) order by n desc, field limit 3",
        **main_views(_FIRST),
        k=_COUNTS.format("r"),
    ),
)
def top_n_features(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return blocks.top_n_features(df, FIELDS, 3, blocks.block_fields(found, [0]))


@query(
    "augment_features",
    views(
        packed_sql("g.schema", _IN_MAIN).replace("cross join m", "cross join g"),
        **main_views(_FIRST),
        k=_COUNTS.format("(select * from r where block_id not in (select block_id from mi))"),
        o="select label, n_main, row_number() over (order by n_main desc, label) as i from mt",
        x="""select o.i, o.n_main, list(k.field order by k.n desc, k.field) filter (where k.n > 0) as ranked
          from o join k using (label) group by 1, 2""",
        grow="""(with recursive grow_steps(i, schema) as (
          select 0::bigint, m.schema from m
          union all
          select x.i, s.schema || (list_filter(x.ranked, lambda f: not list_contains(s.schema, f)))
            [1:(case when x.n_main = 0 then 2 else 1 end)]
          from grow_steps s join x on x.i = s.i + 1)
          select * from grow_steps)""",
        g="select schema from grow order by i desc limit 1",
    ),
)
def augment_features(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.augment_with_features(df, FIELDS, found, 0, few(spark, sf_dir)))


CLASSES = ["click", "signup"]
_DONORS = f"select distinct block_id from r where label in ({', '.join(repr(x) for x in CLASSES)})"
_SPREAD = "select field, count(*) as n from (select unnest(schema) as field from b join dn using (block_id)) group by 1"


def specialist_sql(condition: str) -> str:
    return views(
        packed_sql("xs.schema", f"label in ({', '.join(repr(x) for x in CLASSES)})").replace(
            "cross join m", "cross join xs"
        ),
        **main_views(_FIRST),
        dn=_DONORS,
        sp=_SPREAD,
        xs="select coalesce(list(field), []) as schema from sp cross join m "
        f"where not list_contains(m.schema, field) and {condition}",
    )


@query("specialist_exclusive", specialist_sql("true"))
def specialist_exclusive(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.specialist_set(df, FIELDS, found, 0, CLASSES))


@query("specialist_common", specialist_sql("n = (select count(*) from dn)"))
def specialist_common(spark, sf_dir):
    df, found = block_rows(spark, sf_dir)
    return packed(blocks.specialist_set(df, FIELDS, found, 0, CLASSES, common=True))

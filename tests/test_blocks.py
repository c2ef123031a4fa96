"""Blocks, merge plans, augmentation and trees against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import blocks, trees

FIELDS = ["ip.a", "ip.a.x", "ip.b", "tcp.c", "tcp.d.e", "tls.f.g.h"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        pattern = rng.choice([0b111111, 0b111111, 0b111000, 0b111000, 0b110000, 0b000111, 0b000001, 0b011111, 0])
        if i < 3:
            pattern = 0b101010
        out.append((i, rng.choice(["x", "x", "y", "z"]),
                    *[f"v{i}" if pattern >> (5 - j) & 1 else None for j in range(6)]))
    schema = "packet_id bigint, label string, " + ", ".join(f"`{f}` string" for f in FIELDS)
    return out, spark.createDataFrame(out, schema).repartition(4)


def block_dict(rows):
    found = {}
    for row in rows:
        key = "|".join(f for f, v in zip(FIELDS, row[2:], strict=True) if v is not None)
        found.setdefault(key, []).append(row[0])
    return {i: (key, found[key]) for i, key in enumerate(sorted(found))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_block_table(rows):
    data, df = rows
    got = {r["block_id"]: r for r in blocks.block_table(df, FIELDS).collect()}
    want = block_dict(data)
    assert {k: (r["fingerprint"], r["n_rows"]) for k, r in got.items()} == {
        k: (key, len(ids)) for k, (key, ids) in want.items()
    }
    assert sum(r["n_rows"] for r in got.values()) == len(data)
    assert got[0]["schema"] == []
    assigned = blocks.assign_blocks(df, FIELDS, blocks.block_table(df, FIELDS))
    ids = {r["packet_id"]: r["block_id"] for r in assigned.collect()}
    assert ids == {i: k for k, (_, members) in want.items() for i in members}


def tree_sets(schema):
    nodes, edges = set(), set()
    for f in schema:
        parts = f.split(".")
        for i in range(1, len(parts)):
            parent, child = ".".join(parts[:i]), ".".join(parts[: i + 1])
            nodes |= {parent, child}
            edges.add((parent, child))
    return nodes, edges


def random_blocks(spark, seed, n=40):
    rng = random.Random(seed)
    names = [f"p{i % 4}.q{i % 3}.f{i}" for i in range(12)]
    out = []
    for i in range(n):
        schema = sorted(rng.sample(names, rng.randrange(0 if i else 1, 12)))
        out.append((i, rng.choice([5, 50, 500, 5000]), schema))
    return out, spark.createDataFrame(out, "block_id bigint, n_rows bigint, schema array<string>")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_merge_plan_jaccard(spark, seed, threshold):
    data, df = random_blocks(spark, seed)
    got = {r["block_id"]: (r["role"], r["target_id"]) for r in
           blocks.merge_plan_jaccard(df, 1000, threshold).collect()}
    core = [(i, set(s)) for i, n, s in data if n >= 1000]
    for i, n, schema in data:
        s = set(schema)
        if n >= 1000:
            assert got[i] == ("core", i)
            continue
        inside = [(len(c - s), k) for k, c in core if s <= c]
        near = [(-jaccard(s, c), k) for k, c in core if jaccard(s, c) >= threshold]
        if inside:
            # equally tight supersets: the more similar is the same size, then the smaller id
            assert got[i] == ("merged", min(inside)[1])
        elif near:
            assert got[i] == ("merged", min(near)[1])
        else:
            assert got[i] == ("orphan", None)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_merge_plan_tree(spark, seed, threshold):
    data, df = random_blocks(spark, seed)
    got = {r["block_id"]: (r["role"], r["target_id"]) for r in blocks.merge_plan_tree(df, 1000, threshold).collect()}
    core = [(i, tree_sets(s)) for i, n, s in data if n >= 1000]
    for i, n, schema in data:
        if n >= 1000:
            continue
        nodes, edges = tree_sets(schema)
        scored = sorted((-(0.5 * jaccard(nodes, cn) + 0.5 * jaccard(edges, ce)), k) for k, (cn, ce) in core)
        if scored and -scored[0][0] >= threshold:
            assert got[i] == ("merged", scored[0][1])
        else:
            assert got[i] == ("orphan", None)


def test_no_core_block_leaves_only_orphans(spark):
    _, df = random_blocks(spark, 1)
    plan = blocks.merge_plan_jaccard(df, 10**6, 0.5)
    assert {r["role"] for r in plan.collect()} == {"orphan"}
    assert {r["message"] for r in blocks.merge_log(plan).collect()} == {"Orphaned"}


def test_apply_merge_pads_and_drops(rows):
    data, df = rows
    table = blocks.block_table(df, FIELDS)
    plan = blocks.merge_plan_jaccard(table, 100, 0.5)
    merged = blocks.apply_merge(blocks.assign_blocks(df, FIELDS, table), FIELDS, table, plan)
    assert merged.count() == len(data)
    schemas = {str(r["block_id"]): set(r["schema"]) for r in table.collect()}
    roles = {r["block_id"]: r for r in plan.collect()}
    orphan = set().union(*[schemas[str(k)] for k, r in roles.items() if r["role"] == "orphan"], set())
    for r in merged.collect():
        schema = schemas.get(r["expert"], orphan)
        original = data[r["packet_id"]]
        for j, f in enumerate(FIELDS):
            assert r[f] == ((original[2 + j] or "0") if f in schema else None)


def test_column_blocks(spark):
    data = [(i, "v", "v" if i % 2 else None, "v" if i % 2 else None, "v", "v" if i % 3 else None) for i in range(20)]
    df = spark.createDataFrame(data, "id bigint, a string, b string, c string, d string, e string")
    signatures = blocks.column_signatures(df, ["a", "b", "c", "d", "e"], "id")
    discrete = {r["field"]: r["block"] for r in blocks.column_blocks(signatures, "discrete").collect()}
    assert discrete == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 2}
    runs = {r["field"]: r["block"] for r in blocks.column_blocks(signatures, "continuous").collect()}
    assert runs == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    with pytest.raises(ValueError):
        blocks.column_blocks(signatures, "other")


def test_grow_schema_depends_on_the_class_order(rows):
    data, df = rows
    table = blocks.block_table(df, FIELDS)
    assigned = blocks.assign_blocks(df, FIELDS, table)
    main = 1
    main_schema = table.filter(F.col("block_id") == main).first()["schema"]
    ids = {i: k for k, (_, members) in block_dict(data).items() for i in members}
    n_main = {}
    for row in data:
        n_main.setdefault(row[1], 0)
        n_main[row[1]] += ids[row[0]] == main
    schema = list(main_schema)
    order = sorted((k for k, n in n_main.items() if n < 10**6), key=lambda k: (-n_main[k], k))
    for label in order:
        counts = {f: sum(1 for r in data if r[1] == label and ids[r[0]] != main and r[2 + j] is not None)
                  for j, f in enumerate(FIELDS)}
        fresh = [f for f in sorted(counts, key=lambda f: (-counts[f], f)) if counts[f] and f not in schema]
        schema += fresh[: 2 if n_main[label] == 0 else 1]
    grown, classes = blocks.grow_schema(assigned, FIELDS, table, main, 10**6)
    assert set(grown) == set(schema)
    assert classes == order


def test_specialist_sets(rows):
    data, df = rows
    table = blocks.block_table(df, FIELDS)
    assigned = blocks.assign_blocks(df, FIELDS, table)
    want = block_dict(data)
    ids = {i: k for k, (_, members) in want.items() for i in members}
    donors = {ids[r[0]] for r in data if r[1] == "z"}
    schemas = {k: {f for f in key.split("|") if f} for k, (key, _) in want.items()}
    chief = next(k for k, s in schemas.items() if s == {"tls.f.g.h"})
    any_of = set().union(*[schemas[k] for k in donors]) - schemas[chief]
    all_of = set.intersection(*[schemas[k] for k in donors]) - schemas[chief]
    exclusive = blocks.specialist_set(assigned, FIELDS, table, chief, ["z"])
    assert {c for c in exclusive.columns if c in FIELDS} == any_of
    common = blocks.specialist_set(assigned, FIELDS, table, chief, ["z"], common=True)
    assert {c for c in common.columns if c in FIELDS} == all_of
    assert exclusive.count() == common.count() == sum(1 for r in data if r[1] == "z")


# -- trees ------------------------------------------------------------------------------------------------------


def tree_of(spark, fields, **kwargs):
    df = spark.createDataFrame([(0, f) for f in fields], "g int, field string")
    return df, {(r["parent"], r["child"]) for r in trees.protocol_tree(df, "g", **kwargs).collect()}


def test_logical_tree(spark):
    _, tree = tree_of(spark, ["ip.len", "tls.record.length", "stat"], layers=["ip", "tcp", "tls"])
    assert tree == {
        ("ip", "ip.len"), ("tls", "tls.record"), ("tls.record", "tls.record.length"), ("tcp", None),
        ("statistics", "stat"),
    }


def test_inferred_layers_have_no_statistics(spark):
    _, tree = tree_of(spark, ["ip.len", "stat"])
    assert tree == {("ip", "ip.len"), ("stat", None)}


def test_physical_tree_needs_real_parents(spark):
    fields = ["ip.flags", "ip.flags.df", "ip.opt.deep", "tls.record.length", "tls.record.length.x", "tls.a.b.c"]
    _, tree = tree_of(spark, fields, layers=["ip", "tls"], logical=False)
    assert tree == {
        ("ip", "ip.flags"), ("ip.flags", "ip.flags.df"), ("tls", "tls.record.length"),
        ("tls.record.length", "tls.record.length.x"),
    }


def test_root_and_graph(spark):
    df = spark.createDataFrame([(0, "ip.len"), (0, "tls.r.x")], "g int, field string")
    tree = trees.add_root(trees.protocol_tree(df, "g"), "g")
    root = {r["child"] for r in tree.filter(F.col("parent") == "root").collect()}
    assert root == {"ip", "tls"}
    nodes = {r["node"]: r["node_id"] for r in trees.tree_nodes(tree, "g").collect()}
    assert nodes == {n: i for i, n in enumerate(["ip", "ip.len", "root", "tls", "tls.r", "tls.r.x"])}
    edges = {(r["source"], r["target"]) for r in trees.tree_edges(tree, trees.tree_nodes(tree, "g"), "g").collect()}
    pairs = [("ip", "ip.len"), ("tls", "tls.r"), ("tls.r", "tls.r.x"), ("root", "ip"), ("root", "tls")]
    assert edges == {(nodes[a], nodes[b]) for p, k in pairs for a, b in ((p, k), (k, p))}


def test_root_falls_back_to_dotted_tops(spark):
    tree = spark.createDataFrame([(0, "a.b", "a.b.c")], "g int, parent string, child string")
    assert {r["child"] for r in trees.add_root(tree, "g").collect() if r["parent"] == "root"} == {"a.b"}
    both = spark.createDataFrame([(0, "a.b", "a.b.c"), (0, "x", "x.y")], "g int, parent string, child string")
    assert {r["child"] for r in trees.add_root(both, "g").collect() if r["parent"] == "root"} == {"x"}
    every = trees.add_root(both, "g", mode="all_top")
    assert {r["child"] for r in every.collect() if r["parent"] == "root"} == {"x", "a.b"}


def test_pad_or_truncate(spark):
    data = [(1, None, "x", "[1, 2]", "l"), (2, "v", None, "[]", "l"), (3, "w", None, "[1, 2]", "m")]
    df = spark.createDataFrame(
        data, "index bigint, `ip.a` string, `ip.b` string, `tcp.reassembled_segments` string, label string"
    ).withColumn("ip.none", F.lit(None).cast("string"))
    padded = blocks.pad_or_truncate(df, True, "index")[0].orderBy("index").collect()
    assert [tuple(r) for r in padded] == [
        (1, "ffff", "x", "0", "l"), (2, "v", "ffff", "-1", "l"), (3, "w", "ffff", "0", "m")
    ]
    parts = blocks.pad_or_truncate(df, False, "index")
    assert [p.columns for p in parts] == [
        ["index", "label"], ["index", "ip.a", "label"], ["index", "ip.b", "label"],
        ["index", "tcp.reassembled_segments", "label"],
    ]
    assert [p.count() for p in parts] == [3, 2, 1, 3]
    joined = blocks.pad_or_truncate(df, False, "index", kind="discrete")
    assert [p.columns for p in joined][0] == ["index", "tcp.reassembled_segments", "label"]


def test_more_fields_than_a_word_has_bits(spark):
    names = [f"ip.f{i:03d}" for i in range(140)]
    rows = [(i, *["1" if (i * (k + 1)) % 3 == 0 or k == 139 - i else None for k in range(140)]) for i in range(20)]
    df = spark.createDataFrame(rows, "n bigint, " + ", ".join(f"`{n}` string" for n in names))
    table = blocks.block_table(df, names)
    want = {r[0]: "|".join(n for n, v in zip(names, r[1:], strict=True) if v) for r in rows}
    order = {text: k for k, text in enumerate(sorted(set(want.values())))}
    got = {r["n"]: (r["fingerprint"], r["block_id"]) for r in blocks.assign_blocks(df, names, table).collect()}
    assert got == {n: (text, order[text]) for n, text in want.items()}
    assert {r["fingerprint"]: r["schema"] for r in table.collect()} == {t: t.split("|") for t in order}


def test_block_numbers_need_no_window_over_all_patterns(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(blocks, "small_side", lambda df: seen.append(df) or df)
    table = blocks.block_table(rows[1], FIELDS)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert ranks and all("_bucket" in line for line in ranks)
    joined = blocks.assign_blocks(rows[1], FIELDS, table)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "_set0" in line and "fingerprint" not in line for line in joined.splitlines())


def shared_blocks(spark, n=120, common=30):
    """Core and small blocks that all share 30 fields; every small block resembles one core block besides."""
    rng = random.Random(9)
    base = [f"ip.c{k:02d}" for k in range(common)]
    schemas = {}
    for i in range(1, n, 2):
        own = rng.sample([f"tcp.o{k:04d}" for k in range(2000)], rng.randrange(20, 30))
        schemas[i], schemas[i - 1] = base + own, base + own[3:] + [f"tls.n{i}.{k}" for k in range(3)]
    rows = [(i, "|".join(sorted(s)), "", 2000 if i % 2 else 5, 10, sorted(s)) for i, s in sorted(schemas.items())]
    df = spark.createDataFrame(rows, "block_id bigint, fingerprint string, fingerprint_md5 string, n_rows bigint, n_bytes bigint, schema array<string>")
    return df, {i: set(s) for i, s in schemas.items()}


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_places_bound_the_candidates(spark, threshold):
    df, sets = shared_blocks(spark)
    core, small = blocks.split_core(df, 1000)
    pairs = {(r["block_id"], r["core_id"]) for r in blocks.candidate_pairs(small, core, "schema", threshold).collect()}
    alike = {(a, b) for a in sets if a % 2 == 0 for b in sets if b % 2 and jaccard(sets[a], sets[b]) >= threshold}
    assert len(alike) >= 60 and alike <= pairs
    if threshold == 0.7:
        # all 3 600 pairs share 30 fields; a join on shared fields alone would give every one
        assert len(pairs) < 3600 / 5
    found = {(r["block_id"], r["core_id"]): r["similarity"] for r in blocks.similar_blocks(small, core, threshold).collect()}
    assert {p: round(v, 9) for p, v in found.items() if v >= threshold} == {p: round(jaccard(sets[p[0]], sets[p[1]]), 9) for p in alike}


def test_column_blocks_are_written_in_one_pass(spark, tmp_path):
    rows = [(i, "a", f"{i}", None if i % 2 else "x", None if i % 2 else i, f"{i}") for i in range(40)]
    spark.createDataFrame(rows, "n bigint, label string, p string, q string, r bigint, s string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    signatures = blocks.column_signatures(df, ["p", "q", "r", "s"], "n")
    table = blocks.column_blocks(signatures)
    slices = blocks.column_block_slices(df, table, "n")
    assert [(s.columns, s.count()) for _, s in sorted(slices.items())] == [(["n", "p", "s", "label"], 40), (["n", "q", "r", "label"], 20)]
    assert slices[1].schema["r"].dataType.simpleString() == "bigint"
    for part in slices.values():
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert str(tmp_path) not in plan and "PartitionFilters" in plan and plan.count("FileScan") == 1

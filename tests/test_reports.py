"""Report jobs against counts made by hand."""

import csv
from pathlib import Path

import pytest

from flowloom.operators import blocks, columns, metrics
from flowloom.plans import reports

PACKETS = "frame long, split string, `ip.len` string, `tcp.options.x` string, `tls.y` string"


def write_splits(spark, path, rows):
    spark.createDataFrame(rows, PACKETS).write.partitionBy("split").parquet(path)
    return path


def test_upper_layer_datasets(spark, tmp_path):
    a = write_splits(
        spark, str(tmp_path / "a"),
        [(1, "train", "9", "1", None), (2, "train", "9", "0", ""), (3, "train", "9", None, None),
         (4, "validation", "9", None, "7"), (5, "other", "9", "1", "1")],
    )
    # nothing of b is kept, and it has no validation or test split
    b = write_splits(spark, str(tmp_path / "b"), [(1, "train", "9", "0", None), (2, "train", "9", "", "0")])
    # none of the wanted splits
    other = write_splits(spark, str(tmp_path / "c"), [(1, "other", "9", "5", None)])
    out, summary = str(tmp_path / "out"), str(tmp_path / "summary")
    for force in (False, False, True):
        found = reports.upper_layer_datasets(spark, {"a": a, "b": b, "c": other}, out, summary, force=force)
        rows = {r["dataset"]: r.asDict() for r in found.collect()}
        assert set(rows) == {"a", "b", "c"}
        assert [rows["a"][f"train_{f}"] for f in ("total", "kept", "removed")] == [3, 1, 2]
        assert rows["a"]["train_removed_ratio"] == pytest.approx(2 / 3)
        assert [rows["a"][f"validation_{f}"] for f in ("total", "kept", "removed", "removed_ratio")] == [1, 1, 0, 0.0]
        assert rows["a"]["test_total"] is None
        assert [rows["b"][f"train_{f}"] for f in ("total", "kept", "removed", "removed_ratio")] == [2, 0, 2, 1.0]
        assert set(rows["c"].values()) == {"c", None}
    kept = spark.read.parquet(f"{out}/a").orderBy("frame").collect()
    assert [(r["frame"], r["split"]) for r in kept] == [(1, "train"), (4, "validation")]


def test_upper_layer_datasets_needs_upper_fields(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([(1, "train")], "`ip.len` int, split string").write.partitionBy("split").parquet(path)
    with pytest.raises(ValueError):
        reports.upper_layer_datasets(spark, {"plain": path}, str(tmp_path / "out"), str(tmp_path / "summary"))


def test_block_report(spark, tmp_path):
    fields = ["ip.a", "ip.b", "ip.c"]
    rows = spark.createDataFrame(
        [("x", "1", None, None), ("x", "1", None, None), ("y", "1", "1", None), (None, None, None, "1")],
        "label string, `ip.a` string, `ip.b` string, `ip.c` string",
    )
    table = blocks.block_table(rows, fields)
    out = str(tmp_path / "report")
    reports.block_report(blocks.assign_blocks(rows, fields, table), table, fields, out)
    order = spark.read.parquet(f"{out}/blocks").orderBy("block_id").collect()
    assert [r["fields"] for r in order] == ["ip.a", "ip.a,ip.b", "ip.c"]
    labels = {r["label"]: r["cells"] for r in spark.read.parquet(f"{out}/labels").collect()}
    assert labels == {"x": "2,0,0", "y": "0,1,0"}
    present = {r["field"]: r["cells"] for r in spark.read.parquet(f"{out}/fields").collect()}
    assert present == {"ip.a": "1,1,0", "ip.b": "0,1,0", "ip.c": "0,0,1"}


def test_matrix_lines_of_many_columns(spark):
    cells = spark.range(3000).selectExpr("concat('r', id % 2) as r", "id as col", "id % 7 as v")
    lines = {x["r"]: x["cells"].split(",") for x in blocks.matrix_lines(cells, "r", "col", "v").collect()}
    assert lines["r0"] == [str(i % 7 if i % 2 == 0 else 0) for i in range(3000)]
    assert lines["r1"] == [str(i % 7 if i % 2 else 0) for i in range(3000)]
    assert blocks.matrix_lines(cells.limit(0), "r", "col", "v").count() == 0


def test_confusion_table_and_report(spark, tmp_path):
    rows = [(0, [2.0, 1.0, 0.0], 7), (0, [0.0, 1.0, 0.0], 7), (2, [0.0, 1.0, 3.0], 8), (2, [0.0, 1.0, 3.0], 8)]
    df = spark.createDataFrame(rows, "label_id int, logits array<double>, stream_id long")
    labels = ["web.http", "a b", "Ünï"]
    cm = metrics.confusion_matrix(metrics.packet_predictions(df), 3, extra_columns=1)
    table = metrics.cm_table(cm, labels, ["unknown"]).orderBy("actual_id")
    assert table.columns == ["actual_id", "actual_label", *labels, "unknown"]
    assert [tuple(r) for r in table.collect()] == [
        (0, "web.http", 1, 1, 0, 0), (1, "a b", 0, 0, 0, 0), (2, "Ünï", 0, 0, 2, 0),
    ]
    with pytest.raises(ValueError):
        metrics.cm_table(cm, ["x", "X", "y"])
    out = tmp_path / "cm"
    reports.confusion_report(df, labels, str(out))
    for level, first in (("packet", ["1", "1", "0"]), ("flow", None)):
        (part,) = Path(out, level).glob("*.csv")
        with part.open(encoding="utf-8", newline="") as file:
            read = list(csv.reader(file))
        assert read[0] == ["actual_id", "actual_label", *labels]
        assert [r[1] for r in read[1:]] == labels
        assert first is None or read[1][2:] == first
    assert sum(int(x) for r in read[1:] for x in r[2:]) == 2


def test_upper_layer_table(spark):
    rows = [("a", "train", 4, 1, 3, 0.75), ("b", "test", 2, 2, 0, 0.0)]
    summary = spark.createDataFrame(rows, "dataset string, split string, total long, kept long, removed long, removed_ratio double")
    wide = columns.upper_layer_table(summary, ["train", "test"]).orderBy("dataset").collect()
    assert wide[0].asDict()["train_removed"] == 3
    assert wide[0].asDict()["test_total"] is None
    assert wide[1].asDict()["test_removed_ratio"] == 0.0

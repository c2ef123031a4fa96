"""File readers and writers, dissection parsing, pipelines and incremental ingestion."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import columns
from flowloom.plans import features, importance, preprocess
from flowloom.sources import pdml, tables
from flowloom.streaming.ingest import ingest_pdml


def packet(number, *fields):
    body = "".join(fields)
    return (
        f'<packet>\n<proto name="geninfo"><field name="num" pos="0" show="{number}" value="{number:x}"/></proto>'
        f'<proto name="ip">{body}</proto>\n</packet>\n'
    )


PDML = (
    '<?xml version="1.0"?>\n<pdml version="0">\n'
    + packet(1, '<field name="ip.len" value="28" show="40"><field name="ip.sub" show="7"/></field>')
    + packet(2, '<field name="ip.len" value="29"/><field name="ip.len" value="2a"/>')
    + packet(3, '<field name="ip.hidden" value="1" hide="yes"/><field value="9"/><field name="ip.none"/>')
    + packet(4, f'<field name="ip.long" value="{"a" * 64}"/><field name="ip.edge" value="{"a" * 63}"/>')
    + "<packet><broken></packet>\n"
    + packet(5, '<field name="ip.esc" show="a&amp;b"/>')
    + "</pdml>\n"
)


@pytest.fixture
def pdml_dir(tmp_path):
    for name in ("web/a.xml", "mail/b.xml"):
        path = tmp_path / "pdml" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(PDML)
    (tmp_path / "pdml" / "chat_1.xml").write_text(PDML)
    return str(tmp_path / "pdml")


def test_read_pdml(spark, pdml_dir):
    got = {r["fields"]["frame.number"]: r["fields"] for r in pdml.read_pdml(spark, pdml_dir + "/web").collect()}
    assert set(got) == {"1", "2", "3", "4", "5"}
    assert got["1"] == {"num": "1", "ip.len": "28", "ip.sub": "7", "frame.number": "1"}
    assert got["2"]["ip.len"] == "2a"
    assert set(got["3"]) == {"num", "frame.number"}
    assert set(got["4"]) == {"num", "frame.number", "ip.edge"}
    assert got["5"]["ip.esc"] == "a&b"


def test_broken_packets_are_rejects(spark, tmp_path):
    (tmp_path / "in" / "web").mkdir(parents=True)
    (tmp_path / "in" / "web" / "a.xml").write_text(PDML.replace("</pdml>\n", '<packet><proto name="ip"><field na'))
    outcomes = pdml.read_outcomes(spark, str(tmp_path / "in" / "web"))
    rejects = pdml.rejects_of(outcomes).collect()
    assert len(rejects) == 2 and pdml.packets_of(outcomes).count() == 5
    assert all(r.path.endswith("a.xml") and "<packet>" in r.raw and r.reason.startswith("not well-formed") for r in rejects)
    out = str(tmp_path / "packets")
    assert preprocess.dissection_to_packets(spark, str(tmp_path / "in"), out).count() == 5
    assert spark.read.parquet(out + "_rejects").count() == 2
    assert [pdml.packet_outcome(x) for x in (None, "x", "</pdml>\n")] == [(None, "no text"), (None, "no packet"), (None, None)]


def test_packet_fields_of_bad_text():
    assert pdml.packet_fields(None) is None
    assert pdml.packet_fields("no packet here") is None
    assert pdml.packet_fields("<packet><open>") is None


def test_dissection_to_packets(spark, pdml_dir, tmp_path):
    out = str(tmp_path / "packets")
    df = preprocess.dissection_to_packets(spark, pdml_dir, out)
    assert {r["label"]: r["count"] for r in df.groupBy("label").count().collect()} == {"chat": 5, "web": 5, "mail": 5}
    assert "ip.edge" in df.columns


def test_streaming_ingest_reads_each_file_once(spark, pdml_dir, tmp_path):
    out, state = str(tmp_path / "grown"), str(tmp_path / "state")
    names = ["frame.number", "ip.len", "ip.edge"]
    ingest_pdml(spark, pdml_dir, out, state, names).awaitTermination()
    assert spark.read.parquet(out).count() == 15
    late = tmp_path / "pdml" / "web" / "late.xml"
    late.write_text(packet(9, '<field name="ip.len" value="30"/>'))
    ingest_pdml(spark, pdml_dir, out, state, names).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 16
    assert {r["label"] for r in rows if r["frame.number"] == "9"} == {"web"}


def test_streamed_rejects_are_kept_once(spark, pdml_dir, tmp_path):
    out, state = str(tmp_path / "table"), str(tmp_path / "state")
    ingest_pdml(spark, pdml_dir, out, state, ["ip.len"], files_per_batch=1).awaitTermination()
    ingest_pdml(spark, pdml_dir, out, state, ["ip.len"], files_per_batch=1).awaitTermination()
    rejects = spark.read.parquet(f"{out}_rejects").collect()
    broken = [r for r in rejects if r["reason"].startswith("not well-formed")]
    assert len(broken) == 3 and len({r["path"] for r in broken}) == 3 and all("<broken>" in r["raw"] for r in broken)
    # a batch that is run again after a crash replaces what it wrote
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    before = spark.read.parquet(out).count()
    ingest_pdml(spark, pdml_dir, out, state, ["ip.len"], files_per_batch=1).awaitTermination()
    assert spark.read.parquet(out).count() == before
    assert spark.read.parquet(f"{out}_rejects").count() == len(rejects)


def test_column_names_of_a_header():
    assert tables.column_names('a,"b,c",,A,d') == ("a0", "b,c", "_c2", "A3", "d")


def test_headers_of_many_files_take_a_fixed_number_of_jobs(spark, tmp_path):
    for i in range(500):
        names = ["ip.len", f"tcp.f{i % 3}"]
        (tmp_path / f"l{i % 5}_{i:03d}.csv").write_text(",".join(names) + "\n" + f"{i:x},1\n" * 3)
    (tmp_path / "none.csv").write_text("")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for group, some in [("few", paths[:100]), ("many", paths)]:
        spark.sparkContext.setJobGroup(group, group)
        frames = tables.frames_by_header(spark, some)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 10
    assert sorted(f.columns for f in frames) == [["ip.len", f"tcp.f{k}"] for k in range(3)]
    assert sum(f.count() for f in frames) == 1500


@pytest.fixture
def csv_dir(tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "web_1.csv").write_text("frame.number,ip.src,ip.dst,tcp.srcport,tcp.dstport,ip.proto,ip.len,label\n" + "".join(
        f"{i},c0a8000{i % 3},c0a800ff,c00{i % 3},1bb,06,{40 + i:x},old\n" for i in range(40)))
    (folder / "mail_2.csv").write_text("ip.len,ip.src,ip.dst,tcp.srcport,tcp.dstport,ip.proto,tls.record.length\n" + "".join(
        f"{60 + i:x},c0a800ff,c0a8010{i % 9},19,d00{i % 9},06,\n" for i in range(90)))
    (folder / "mail_1.csv").write_text("ip.len\n28\n")
    (folder / "notes.txt").write_text("x")
    return str(folder)


def test_discover_and_label(spark, csv_dir):
    found = tables.discover_files(spark, csv_dir, suffix=".csv")
    assert {r["base_name"] for r in found.collect()} == {"web_1", "mail_1", "mail_2"}
    assert {r["base_name"] for r in tables.discover_files(spark, csv_dir, "mail", ".csv").collect()} == {
        "mail_1", "mail_2"
    }
    df = spark.createDataFrame([("/r/web_1.csv",), ("/r/mail/x_1.pcap",)], "p string")
    by_folder = [r[0] for r in df.select(tables.label_from_path(F.col("p"), "/r")).collect()]
    assert by_folder == ["web", "mail"]
    assert [r[0] for r in df.select(tables.label_from_path(F.col("p"))).collect()] == ["web", "x"]


@pytest.mark.parametrize("split_bytes", [None, 200])
def test_consolidate_csvs_numbers_rows_by_path(spark, csv_dir, split_bytes):
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        paths = [r["path"] for r in tables.discover_files(spark, csv_dir, suffix=".csv").collect()]
        got = tables.consolidate_csvs(spark, paths).orderBy("frame_num").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["frame_num"] for r in got] == list(range(1, 132))
    assert [r["label"] for r in got] == ["mail"] * 91 + ["web"] * 40
    assert [r["ip.len"] for r in got] == ["28"] + [f"{60 + i:x}" for i in range(90)] + [f"{40 + i:x}" for i in range(40)]
    assert set(got[0].asDict()) == {
        "frame_num", "label", "ip.dst", "ip.len", "ip.proto", "ip.src", "tcp.dstport", "tcp.srcport",
        "tls.record.length",
    }


def test_write_table_skips_finished_work(spark, tmp_path):
    out = str(tmp_path / "t")
    assert tables.write_table(spark.range(3), out)
    assert not tables.write_table(spark.range(9), out)
    assert spark.read.parquet(out).count() == 3
    assert tables.write_table(spark.range(9), out, force=True)
    tables.append_table(spark.range(2).selectExpr("cast(id as string) s"), str(tmp_path / "a"), ["s", "extra"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {("0", "0"), ("1", "0")}


def test_vocab_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([("f", "0x'\"1", 1), ("f", "__OOV__", 0)], "field string, value string, id bigint")
    tables.write_vocab(vocab, str(tmp_path / "v"))
    assert sorted(tables.read_vocab(spark, str(tmp_path / "v")).collect()) == sorted(vocab.collect())


def test_preprocessing_and_features(spark, csv_dir, tmp_path):
    out = str(tmp_path / "out")
    options = preprocess.PreprocessOptions(min_block_rows=10, min_class_rows=50)
    done = preprocess.run_preprocessing(
        spark, {"good": csv_dir, "bad": str(tmp_path / "missing")}, out, options, with_chief=True
    )
    assert done["good"] == "done"
    assert done["bad"].startswith("failed")
    split = spark.read.parquet(f"{out}/good/split")
    assert split.count() == 131
    flows = split.groupBy("label", "stream_id").agg(F.countDistinct("split").alias("n"))
    assert flows.agg(F.max("n")).first()[0] == 1
    assert preprocess.read_split(spark, f"{out}/good/split", "train").count() > 0
    chief = spark.read.parquet(f"{out}/good/chief")
    assert chief.count() > 0
    featured = features.build_features(split, options=features.FeatureOptions(cap_train=3, drop_unseen=False))
    assert featured.count() <= 131
    assert {"flow_avg_len", "flow_dir_sign", "label_id"} <= set(featured.columns)
    assert featured.groupBy("stream_id", "split").count().filter("split = 'train' and count > 3").count() == 0
    encoded = features.encode_features(featured)
    assert encoded.filter(F.col("`ip.len`") < 0).count() == 0


def test_importance_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "ip.len", 0.5), ("a", "x", 0.2)],
                               "expert_name string, feature_name string, importance_score double")
    importance.write_reports(df, str(tmp_path / "r"), valid_only=True)
    assert spark.read.parquet(str(tmp_path / "r" / "field_ngi_tau_0_2")).count() == 1
    expert_ngi, gcs = importance.expert_reports(df)
    assert expert_ngi.count() == 2
    assert gcs.count() == 1


def test_column_helpers(spark):
    df = spark.createDataFrame([("a", "1", None), ("label", None, "2"), ("b", "", "0")],
                               "label string, `tcp.options.x` string, `tls.y` string")
    assert columns.drop_repeated_headers(df).count() == 2
    assert columns.tcp_only(df).count() == 2
    assert columns.row_count(df, F.col("label") == "a") == 1
    assert [r["label"] for r in columns.upper_layer_filter(df).orderBy("label").collect()] == ["a", "label"]
    with pytest.raises(ValueError):
        columns.upper_layer_filter(df.select("label"))
    assert columns.drop_all_null_columns(df.filter("label = 'b'")).columns == ["label", "tls.y"]
    assert columns.keep_prefix_columns(df, ["tls."], ["label"]).columns == ["label", "tls.y"]
    first, second = columns.lock_schema([df, df.select("label")], "first", "0")
    assert first.columns == second.columns == df.columns
    union = columns.lock_schema([df.select("label"), df.select("`tls.y`")], "union")
    assert union[0].columns == ["label", "tls.y"]
    assert columns.valid_flow_rows(df.withColumn("stream_id", F.col("`tls.y`"))).count() == 2


def test_merge_csv_folders(spark, tmp_path):
    root = tmp_path / "labels"
    for name, text in (("web/a.csv", "x,y\n1,2\n"), ("web/b.csv", "y,z\n3,4\n"), ("mail/c.csv", "x\n5\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    merged = tables.merge_label_folders(spark, str(root), add_label=True)
    assert set(merged) == {"web", "mail"}
    web = {(r["x"], r["y"], r["z"], r["label"]) for r in merged["web"].collect()}
    assert web == {("1", "2", None, "web"), (None, "3", "4", "web")}
    everything = tables.merge_csvs(spark, str(root))
    assert everything.count() == 3
    assert set(everything.columns) == {"x", "y", "z"}
    assert tables.merge_csvs(spark, str(root), prefix="c").count() == 1


def test_consolidate_keeps_rows_when_splits_change(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "web_1.csv").write_text("ip.len\n" + "\n".join(f"{i:08x}" for i in range(20_000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = tables.consolidate_csvs(spark, [str(tmp_path / "in" / "web_1.csv")])
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = got.orderBy("frame_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.frame_num for r in rows] == list(range(1, 20_001)) and [int(r["ip.len"], 16) for r in rows] == list(range(20_000))

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from sparkloom import runtime
from sparkloom.operators.malformed_rows import parse_records, refused
from sparkloom.operators.wide_cells import cells_of, compact, deltas
from sparkloom.streaming import stateful, upserts

ROW = "row_id bigint, year int, industry_code_anzsic string, rme_size_grp string, variable string, value string, loaded_at timestamp_ntz"


def test_upserts_equal_one_compaction(spark, tmp_path):
    attributes = spark.createDataFrame([("V1", "Staff cost", "decimal", "money", "KDOL"), ("V2", "Foreign owned", "boolean", None, None)], "attr_code string, attr_name string, value_type string, quantity string, common_unit string")
    rows = [(i, 2000 + i % 3, "A", "ALL", "Staff cost" if i % 2 else "Foreign owned", str(i % 5) if i % 2 else "yes", dt.datetime(2024, 3, 1) + dt.timedelta(hours=i * 7 % 60)) for i in range(60)]
    source, runs, shared = str(tmp_path / "in"), str(tmp_path / "runs"), Path(runtime.shared_dir(spark).removeprefix("file://"))
    want = {tuple(r) for r in compact(deltas(cells_of(spark.createDataFrame(rows, ROW), attributes))).collect()}
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], ROW).coalesce(1).write.mode("append").parquet(source)
        stream, before = spark.readStream.schema(ROW).parquet(source), sorted(shared.iterdir())
        upserts.write_deltas(stream, attributes, runs, str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(shared.iterdir()) == before  # a micro-batch leaves nothing behind
        if k == 1:
            upserts.compact_runs(spark, runs)
    assert {tuple(r) for r in upserts.read_compacted(spark, runs).collect()} == want
    upserts.compact_runs(spark, runs)
    assert [n for n in upserts._Store(spark, runs).names() if not n.startswith(".")] == ["_manifest-2", "base=2"]
    assert {tuple(r) for r in upserts.read_compacted(spark, runs).collect()} == want


@pytest.mark.parametrize("fails_at", ["write_text", "delete"])
def test_compaction_that_dies_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, fails_at):
    attributes = spark.createDataFrame([("V1", "Staff cost", "decimal", "money", "KDOL")], "attr_code string, attr_name string, value_type string, quantity string, common_unit string")
    runs = str(tmp_path / "runs")

    def add(number, value):
        rows = spark.createDataFrame([(number, 2000, "A", "ALL", "Staff cost", value, dt.datetime(2024, 3, 1) + dt.timedelta(hours=number))], ROW)
        deltas(cells_of(rows, attributes, F.lit(number).cast("bigint"))).write.parquet(f"{runs}/run={number}")

    def cells():
        return [(r.text, r.least, r.greatest) for r in upserts.read_compacted(spark, runs).collect()]

    def dies(*_):
        raise OSError("killed")

    add(0, "5")
    add(1, "3")
    upserts.compact_runs(spark, runs)
    add(2, "9")
    want = cells()
    with monkeypatch.context() as m:
        m.setattr(upserts._Store, fails_at, dies)
        with pytest.raises(OSError, match="killed"):
            upserts.compact_runs(spark, runs)
    assert cells() == want == [("9.0", "3.0", None)]
    add(3, "1")
    upserts.compact_runs(spark, runs)
    assert cells() == [("1.0", None, "9.0")]
    assert len([n for n in upserts._Store(spark, runs).names() if not n.startswith(".")]) == 2


def test_state_lives_on_between_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, rows in enumerate([[("a", 2, 5), ("a", 1, 7)], [("a", 3, 1), ("b", 1, 2)]]):
        spark.createDataFrame(rows, "k string, t int, v int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t int, v int").parquet(source)
        out = stateful.stateful_map_concat(stream, "k", "t", lambda: 0, lambda s, r: (s + r["v"], [{"k": r["k"], "t": r["t"], "s": s + r["v"]}]), "k string, t int, s int")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 7), ("a", 2, 12), ("a", 3, 13), ("b", 1, 2)]


def test_refused_records_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 2, "bad"), (2, 3, "2010,A,n,ALL,V,1,kg")], "line_id bigint, line_no int, raw_line string").write.parquet(source)
    stream = spark.readStream.schema("line_id bigint, line_no int, raw_line string").parquet(source)
    refused(parse_records(stream)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["columns"]


def test_cuts_are_deleted(spark):
    shared = Path(runtime.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    kept = runtime.cut(spark.range(5))
    with runtime.passing_cuts(spark):
        assert runtime.cut(spark.range(3)).count() == 3
    assert kept.count() == 5 and len(set(shared.iterdir()) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(Session())

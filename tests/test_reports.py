"""Text reports, tables of a profiler's database, labels and the critical path."""

import sqlite3

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spanweave.operators import labels
from spanweave.sources import reports, shards, sinks, wire

SUMMARY = """==7== Profiling result:
            Type  Time(%)      Time     Calls       Avg       Min       Max  Name
 GPU activities:   75.00%  3.0000s       400  7.5000ms  500.00us  9.0000ms  void add_rows<int>(int*, int)
                   25.00%  1.0000s      1000  1.0000ms     800ns  2.0000ms  [CUDA memset]
      API calls:  100.00%  8.0000s        20  400.00ms  1.0000ms  2.50000s  cudaFree
"""
LOG = """[01/01/2020-00:00:00] [I] Host Latency
[01/01/2020-00:00:00] [I] min: 1.5 ms (end to end 2.5 ms)
[01/01/2020-00:00:00] [I] percentile: 3.5 ms at 99% (end to end 4.5 ms at 99%)
[01/01/2020-00:00:00] [I] throughput: 10 qps
[01/01/2020-00:00:00] [I] total compute time: 2.25 s
[01/01/2020-00:00:00] [I] GPU Compute
[01/01/2020-00:00:00] [I] mean: 7 ms
[01/01/2020-00:00:00] [I] percentile: 8 ms at 90%
"""


def test_profile_summary(spark, tmp_path):
    (tmp_path / "a.txt").write_text(SUMMARY)
    (tmp_path / "b.txt").write_text("==1== No kernels were profiled.\n")
    rows = [tuple(r)[1:] for r in reports.profile_summary(spark, str(tmp_path)).orderBy("section", "calls").collect()]
    assert rows == [
        ("api_calls", 1.0, 8.0, 20, pytest.approx(0.4), pytest.approx(1e-3), 2.5, "cudaFree"),
        ("gpu_activities", 0.75, 3.0, 400, pytest.approx(7.5e-3), pytest.approx(500e-6), pytest.approx(9e-3), "void add_rows<int>(int*, int)"),
        ("gpu_activities", 0.25, 1.0, 1000, pytest.approx(1e-3), pytest.approx(800e-9), pytest.approx(2e-3), "[CUDA memset]"),
    ]


def test_inference_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("warm-up took 3 ms\n" + LOG)
    rows = {(r.section, r.name): r.value for r in reports.inference_log(spark, str(tmp_path)).collect()}
    assert rows == {
        ("host_latency", "min_ms"): 2.5,
        ("host_latency", "percentile_99_ms"): 4.5,
        ("host_latency", "throughput_qps"): 10.0,
        ("host_latency", "total_compute_time_s"): 2.25,
        ("gpu_compute", "mean_ms"): 7.0,
        ("gpu_compute", "percentile_90_ms"): 8.0,
    }


def test_database_tables(spark):
    kernels = spark.createDataFrame([(1000, 3500, 7), (0, 1, 8)], "start long, end long, name long")
    strings = spark.createDataFrame([(7, "k")], "_id_ long, value string")
    copies = spark.createDataFrame([(2000, 4000, 1), (5000, 6000, 99)], "start long, end long, copyKind int")
    rows = sorted(map(tuple, reports.kernel_times(kernels, strings, copies).collect()))
    assert rows == [("99", 5.0, 6.0, 1.0), ("[CUDA memcpy HtoD]", 2.0, 4.0, 2.0), ("k", 1.0, 3.5, 2.5)]
    calls = spark.createDataFrame([(0, 1000, 5)], "start long, end long, cbid int")
    names = spark.createDataFrame([(5, "cuInit")], "cbid int, name string")
    assert sorted(map(tuple, reports.api_times(calls, calls.withColumn("cbid", F.lit(6)), names).collect())) == [("6", 0.0, 1.0, 1.0), ("cuInit", 0.0, 1.0, 1.0)]


def test_database_files(spark, tmp_path):
    for name, rows in (("a.db", [(1, 2, "x"), (3, None, "y")]), ("b.db", [(5, 6, None)])):
        base = sqlite3.connect(tmp_path / name)
        base.execute("CREATE TABLE spans (start INTEGER, stop INTEGER, name TEXT)")
        base.executemany("INSERT INTO spans VALUES (?, ?, ?)", rows)
        base.commit()
        base.close()
    found = reports.database_table(spark, str(tmp_path), "spans", "start long, stop long, name string").collect()
    assert sorted(map(tuple, found)) == [(1, 2, "x"), (3, None, "y"), (5, 6, None)]
    assert reports.database_table(spark, str(tmp_path), "others", "a long").count() == 0


def test_reduced_labels(spark):
    df = spark.createDataFrame([(1, ["Framework API C", "GPU"], ["CPU", "GPU"]), (2, ["GPU"], ["GPU"]), (3, ["Python", "CUDA API CPU"], ["CPU"])], "i int, categories array<string>, resources array<string>")
    assert {r.i: r.category for r in labels.reduced_labels(df).collect()} == {1: "Backend", 2: "", 3: "CUDA + Python"}
    assert df.select(labels.split_plus(labels.join_plus(F.col("resources"))).alias("x")).first().x == ["CPU", "GPU"]


def test_critical_path(spark):
    phases = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0), ("d", 1.0)], "phase string, length double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "before string, after string")
    assert {r.phase: (r.total, r.previous) for r in labels.critical_path(phases, edges).collect()} == {"a": (1.0, None), "b": (6.0, "a"), "c": (3.0, "a"), "d": (7.0, "b")}
    with pytest.raises(ValueError):
        labels.critical_path(phases, edges.union(spark.createDataFrame([("d", "a")], "before string, after string")))


def test_wide_trace_csv(spark, tmp_path):
    """Profiles with metrics have many columns, and the name in the last one."""
    more = ",".join(f'"m{i}, %"' for i in range(60))
    (tmp_path / "wide.csv").write_text(f'"Start","Duration",{more},"Name"\nus,us,{"," * 59},\n1,2,{",".join("0" * 60)},"say ""k"", <4>"\n7,1,{",".join("0" * 60)},plain\n')
    rows = shards.trace_csv(spark, str(tmp_path), {"m59, %": "last"}).orderBy("start_us").collect()
    assert [tuple(r)[1:] for r in rows] == [('say "k", <4>', 1, 3, "0"), ("plain", 7, 8, "0")]


def test_wire_numbers_and_unknown_fields():
    """Known bytes of the public wire format; fields of other numbers and of all wire types are skipped."""
    assert wire.encode({"thread_id": 150, "name": "testing"}, wire.EVENT) == bytes.fromhex("089601") + b"\x22\x07testing"
    assert wire.encode({"duration_us": -1}, wire.EVENT) == b"\x18" + b"\xff" * 9 + b"\x01"
    unknown = bytes.fromhex("780162026869") + b"\x6d\x01\x02\x03\x04" + b"\x71" + b"12345678"
    got = wire.decode(unknown + wire.encode({"start_time_us": -5, "name": "é"}, wire.EVENT) + unknown, wire.EVENT)
    assert got == {"thread_id": 0, "start_time_us": -5, "duration_us": 0, "name": "é"}
    assert wire.decode(b"", wire.MESSAGES["process"])["training_progress"] is None
    assert wire.decode(b"\x22\x00", wire.MESSAGES["process"], {"phase": None}) == {"phase": ""}
    nested = {"overhead_events": [("CUPTI", {"phase_overhead_events": [("p", {"operation_name": "o", "num_overhead_events": 3})]})]}
    assert wire.decode(wire.encode(nested, wire.MESSAGES["op_stack"]), wire.MESSAGES["op_stack"]) == {"process_name": "", "phase": "", "machine_name": ""} | nested


@pytest.mark.parametrize("data", [b"\x22", b"\x22\x05abc", b"\x08", b"\x08" + b"\xff" * 11, b"\x0b", b"\x22\x01", b"\x0d\x01\x02", b"\x20\x01"])
def test_damaged_messages_are_errors(data):
    with pytest.raises(ValueError):
        wire.decode(data, wire.EVENT)


def test_binary_shards(spark, tmp_path):
    (tmp_path / "a").mkdir()
    event = {"thread_id": 1, "start_time_us": 5, "duration_us": 3, "name": "f"}
    shard = wire.encode({"category_events": {"Python": {"events": [event, event]}, "": {}}, "process_name": "p", "phase": "x", "machine_name": "m"}, wire.MESSAGES["category_events"])
    (tmp_path / "a" / "category_events.1.proto").write_bytes(shard)
    (tmp_path / "category_events.2.proto").write_bytes(b"")
    (tmp_path / "other.1.proto").write_bytes(b"\xff\xff")
    rows = wire.read_binary_shards(spark, str(tmp_path), "category_events")
    assert [(r.machine, r.process, r.category, r.event_name, r.end_us) for r in shards.category_events(rows).collect()] == [("m", "p", "Python", "f", 8)] * 2
    few = wire.read_binary_shards(spark, str(tmp_path), "category_events", columns=["phase"])
    assert few.columns == ["phase"] and sorted(r.phase for r in few.collect()) == ["x"]  # Spark gives no row for an empty file
    (tmp_path / "category_events.3.proto").write_bytes(shard[:-1])
    with pytest.raises(PythonException, match="category_events.3"):
        wire.read_binary_shards(spark, str(tmp_path), "category_events").collect()


def test_binary_progress(spark, tmp_path):
    """Numbers and parts of a shard that no map holds, written and read."""
    row = spark.createDataFrame([("p", "x", "m", 1, 100, 5, 0.25, 7, 0, 0.5, 9, 50)], shards.SHARDS["training_progress"][1])
    wire.write_binary_shards(row.union(row), str(tmp_path), "training_progress")
    assert wire.read_binary_shards(spark, str(tmp_path), "training_progress").select(row.columns).collect() == [row.first()] * 2


@pytest.mark.parametrize("range_bytes", [1 << 30, 5000, 700])
def test_database_ranges(spark, tmp_path, range_bytes):
    """Written by tasks and read by ranges of row ids, with gaps among these and an empty file; a file that is no database is an error."""
    rows = [(i, None if i % 7 == 0 else f"n{i}", i / 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, value double")
    assert sinks.write_databases(df.repartition(3), f"{tmp_path}/x", "spans").agg(F.sum("n")).first()[0] == 500
    base = sqlite3.connect(tmp_path / "x" / "gaps.db")
    base.execute("CREATE TABLE spans (id INTEGER, name TEXT, value REAL)")
    base.executemany("INSERT INTO spans (rowid, id) VALUES (?, ?)", [(-5, 900), (1, 901), (10**12, 902)])
    base.commit()
    base.close()
    (tmp_path / "x" / "none.db").write_bytes(b"")
    found = reports.database_table(spark, f"{tmp_path}/x", "spans", "id long, name string, value double", range_bytes)
    assert sorted(map(tuple, found.collect())) == rows + [(i, None, None) for i in (900, 901, 902)]
    (tmp_path / "x" / "text.db").write_bytes(b"no database at all" * 100)
    with pytest.raises(Exception, match="not a database"):
        reports.database_table(spark, f"{tmp_path}/x", "spans", "id long", range_bytes).count()

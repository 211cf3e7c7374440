"""Small cases of the third round's findings."""

import pytest
from pyspark.errors import PythonException

from spanweave.operators import flatten, stats
from spanweave.sources import reports, shards, sinks, wire


def test_histogram_of_like_values(spark):
    """Bins without a width hold nothing."""
    rows = stats.histogram(spark.createDataFrame([(950,)] * 3, "x long"), "x", 4).orderBy("bin").collect()
    assert [tuple(r) for r in rows] == [(i, 0, 0, None) for i in range(4)]


def test_venn_of_exclusive_sizes(spark, tmp_path):
    """A label that is never alone keeps its name in a file, and gets no row."""
    rows = [("p", ["CPU", "GPU"], 3), ("p", ["GPU"], 2), ("q", ["B", "C"], 7), ("q", ["A", "B", "C"], 1), ("r", ["A"], 0)]
    df = spark.createDataFrame([("m", "x", *r) for r in rows], "machine string, phase string, process string, region array<string>, time_us long")
    by = ["machine", "process", "phase"]
    sinks.write_venn(sinks.venn_documents(df, by, "ResourceOverlap"), by, str(tmp_path / "v"))
    back = shards.venn_rows(spark, f"{tmp_path}/v/*/*/*/").collect()
    assert sorted((r.process, r.region, r.size) for r in back) == sorted(rows)


def test_database_ranges_are_bounded(spark, tmp_path):
    """However small the ranges that are asked for, a file is staged a fixed number of times at most; all its rows come."""
    df = spark.range(20_000).selectExpr("id", "id % 7 AS k")
    assert sinks.write_databases(df.repartition(2), f"{tmp_path}/x", "spans").agg({"n": "sum"}).first()[0] == 20_000
    found = reports.database_table(spark, f"{tmp_path}/x", "spans", "id long, k long", 100)
    assert found.rdd.getNumPartitions() <= 2 * reports.MOST_RANGES
    assert found.selectExpr("count(DISTINCT id)", "sum(id)", "sum(k)").first() == df.selectExpr("count(DISTINCT id)", "sum(id)", "sum(k)").first()


OPS = [(i, f"n{i % 5}" if i % 9 else None, s, s + n) for i, (s, n) in enumerate([(x * 37 % 101, (x * 53 % 40) * (x % 11 > 0)) for x in range(90)] * 2)]
SCHEMA = "process string, event_id long, event_name string, start_us long, end_us long"


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_stacks_without_pairs(spark, bucket):
    """Depths, stacks, self times and held events of heavily nested operations, with operations alike and without names, lengths or ends."""
    df = spark.createDataFrame([("p", *r) for r in OPS] + [("q", 900, "x", 5, 9), ("q", 901, "y", None, 9), ("q", 902, "z", 5, None)], SCHEMA)
    depth, stack = {900: (0, ""), 901: (0, ""), 902: (0, "")}, {900: ("x", 900)}
    for i, _, s, e in OPS:
        over = sorted((s2, j, n) for j, n, s2, e2 in OPS if s2 <= s and e <= e2 and i != j)
        depth[i] = len(over), ";".join(n for _, _, n in over if n)
        held = sorted((s2, -e2, j, n) for j, n, s2, e2 in OPS if s2 <= s and e <= e2 and (s2 < s or e2 > e or j <= i))
        stack[i] = ";".join(h[3] for h in held if h[3]), held[0][2]
    assert {r.event_id: (r.depth, r.stack) for r in flatten.stack_depths(df, ["process"], bucket).collect()} == depth
    assert {r.event_id: (r.stack, r.root) for r in flatten.stacks(df, ["process"], bucket).collect()} == stack
    named = df.filter("event_name is not null")
    pieces = flatten.flatten_ops(named, ["process"], bucket).join(flatten.stacks(named, ["process"], bucket), ["process", "event_id"])
    want = {r[0]: r[1] for r in pieces.selectExpr("concat(process, ';', stack) AS s", "end_us - start_us AS us").groupBy("s").agg({"us": "sum"}).collect()}
    assert {r.stack: r.us for r in flatten.self_times(named, ["process"], bucket).collect()} == want
    points = [(i, s, s + i % 6) for i, s in enumerate(range(0, 140, 3))]
    asked = spark.createDataFrame([("p", i, None, s, e) for i, s, e in points] + [("r", 1, "x", 5, 6)], SCHEMA)
    few = OPS[:12]
    got = flatten.held_events(spark.createDataFrame([("p", *r) for r in few], SCHEMA), asked, ["process"], bucket)
    assert got.columns == asked.columns
    assert sorted(r.event_id for r in got.collect()) == [i for i, s, e in points if any(s2 <= s and e <= e2 for _, _, s2, e2 in few)]


def test_stacks_are_made_where_they_are_given_out(spark):
    """What is shuffled are operations, not pairs of them: 600 operations that hold each other leave no join behind the buckets."""
    df = spark.createDataFrame([("p", i, "n", i, 2000 - i) for i in range(600)], SCHEMA)
    for found in (flatten.stack_depths(df, ["process"]), flatten.stacks(df, ["process"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "collect_list" not in plan and plan.count("Exchange hashpartitioning") <= 1
        assert found.count() == 600


def test_shards_put_together(spark, tmp_path, monkeypatch):
    """Many messages share files, beside files of one message each; a file that ends early is an error."""
    monkeypatch.setattr(wire, "BATCH_BYTES", 300)
    df = spark.range(500).selectExpr("concat('p', id) AS process_name", "'x' AS phase", "'m' AS machine_name", "'q' AS parent_process_name", "named_struct('content_code', 0, 'percent_complete', float(0.5), 'num_timesteps', id, 'total_timesteps', id * 2) AS training_progress")
    want = sorted(map(tuple, df.collect()))
    wire.write_binary_shards(df.repartition(3, "process_name"), str(tmp_path), "process", 4000)
    files = sorted(tmp_path.glob("*.protos"))
    assert 3 <= len(files) <= 20
    wire.write_binary_shards(df.filter("training_progress.num_timesteps < 4"), str(tmp_path), "process")
    got = wire.read_binary_shards(spark, str(tmp_path), "process").select(df.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want + [tuple(r) for r in df.filter("training_progress.num_timesteps < 4").collect()])
    files[0].write_bytes(files[0].read_bytes()[:-1])
    with pytest.raises(PythonException, match="ends within a message"):
        wire.read_binary_shards(spark, str(tmp_path), "process").collect()


def test_dense_stretches_have_several_shards(spark, monkeypatch):
    """Shards have a bounded number of events, however many are in a stretch; together they hold each once."""
    monkeypatch.setattr(sinks, "SHARD_EVENTS", 50)
    df = spark.range(1000).selectExpr("'m' AS machine", "'p' AS process", "'x' AS phase", "concat('c', id % 3) AS category", "concat('e', id) AS event_name", "id % 10 AS start_us", "5L AS duration_us")
    rows = sinks.shard_rows(df, 1_000_000)
    assert 15 <= rows.count() <= 20
    events = rows.selectExpr("explode(category_events) AS (category, v)").selectExpr("category", "explode(v.events) AS e").selectExpr("category", "e.name", "e.start_time_us")
    assert sorted(map(tuple, events.collect())) == sorted((f"c{i % 3}", f"e{i}", i % 10) for i in range(1000))

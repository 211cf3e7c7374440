"""Operators on small hand-made traces."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanweave.functions import predicates
from spanweave.operators import flatten, overhead, rollup, stats, sweep
from spanweave.plans import lineage
from spanweave.sources import shards, sinks
from spanweave.streaming import live


def events(spark, spans):
    rows = [("m", "p", "x", k, k, i, a, b) for i, (k, a, b) in enumerate(spans)]
    return spark.createDataFrame(rows, "machine string, process string, phase string, key string, event_name string, event_id long, start_us long, end_us long")


def regions(df):
    return {"".join(r.region): (r.time_us, r.min_start_us, r.max_end_us) for r in df.collect()}


SPANS = [("A", 3, 7), ("A", 8, 10), ("B", 1, 4), ("B", 6, 9), ("C", 2, 5), ("C", 7, 8), ("C", 11, 12)]


@pytest.mark.parametrize("bucket", [1, 2, 5, 1000])
def test_sweep_with_bounds(spark, bucket):
    want = {"A": (2, 5, 10), "B": (1, 1, 2), "C": (1, 11, 12), "AB": (2, 6, 9), "AC": (1, 4, 5), "BC": (2, 2, 8), "ABC": (1, 3, 4)}
    assert regions(sweep.region_times(events(spark, SPANS), bucket=bucket)) == want


def test_self_overlap_counts_once(spark):
    spans = [("1", 3, 4), ("1", 8, 10), ("1", 3, 7), ("2", 1, 4), ("2", 6, 9), ("0", 5, 5)]
    found = {k: v[0] for k, v in regions(sweep.region_times(events(spark, spans), bucket=3)).items()}
    assert found == {"1": 3, "2": 3, "12": 3}


def test_sweep_is_the_same_after_merging_and_adds_up(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ABC"), s, s + rng.randint(0, 30)) for s in (rng.randint(0, 300) for _ in range(200))]
    df = events(spark, spans)
    merged = sweep.merge_adjacent(df, ["machine", "process", "phase", "key"], bucket=16)
    once, again = regions(sweep.region_times(df, bucket=7)), regions(sweep.region_times(merged, bucket=64))
    assert {k: v[0] for k, v in once.items()} == {k: v[0] for k, v in again.items()}
    covered = {t for _, a, b in spans for t in range(a, b)}
    assert sum(v[0] for v in once.values()) == len(covered)


def test_merge_touching(spark):
    df = events(spark, [("a", 1, 6), ("a", 2, 6), ("a", 3, 7), ("a", 4, 6), ("a", 9, 10), ("a", 10, 12)])
    assert sorted(tuple(r) for r in sweep.merge_adjacent(df, ["key"], bucket=4).collect()) == [("a", 1, 7), ("a", 9, 12)]


def test_transitions_with_gap(spark):
    found = {("".join(r.previous), "".join(r.region)): r.n for r in sweep.transitions(events(spark, [("A", 0, 2), ("B", 1, 2), ("A", 5, 6)]), bucket=2).collect()}
    assert found == {("", "A"): 2, ("A", "AB"): 1, ("AB", ""): 1}


@pytest.mark.parametrize(
    "spans, want",
    [
        ([("A", 1, 2), ("B", 0, 3)], [("B", 0, 1), ("A", 1, 2), ("B", 2, 3)]),
        ([("A", 0, 1), ("B", 0, 3)], [("A", 0, 1), ("B", 1, 3)]),
        ([("A", 2, 3), ("B", 0, 3)], [("B", 0, 2), ("A", 2, 3)]),
        ([("A", 1, 2), ("A", 3, 4), ("B", 0, 5)], [("B", 0, 1), ("A", 1, 2), ("B", 2, 3), ("A", 3, 4), ("B", 4, 5)]),
        ([("1", 0, 5), ("2", 1, 4), ("3", 2, 3), ("4", 5, 8), ("5", 6, 7), ("[x]", 0, 9), ("6", 4, 4)], [("1", 0, 1), ("2", 1, 2), ("3", 2, 3), ("2", 3, 4), ("1", 4, 5), ("4", 5, 6), ("5", 6, 7), ("4", 7, 8)]),
    ],
)
@pytest.mark.parametrize("bucket", [2, 100])
def test_flatten(spark, spans, want, bucket):
    found = flatten.flatten_ops(events(spark, spans), bucket=bucket).orderBy("start_us").collect()
    assert [(r.event_name, r.start_us, r.end_us) for r in found] == want


def test_bad_nesting(spark):
    df = events(spark, [("a", 0, 5), ("b", 3, 8), ("c", 1, 2), ("d", 1, 2)])
    assert sorted((r.event_id, r.other_id) for r in flatten.bad_nesting(df, bucket=2).collect()) == [(0, 1), (2, 3)]


VENN = [
    ({"0": 6, "1": 6, "2": 6, "01": 2, "02": 2, "12": 2, "012": 1}, {"0": 3, "1": 3, "2": 3, "01": 1, "02": 1, "12": 1, "012": 1}),
    ({"0": 5, "1": 5, "01": 2}, {"0": 3, "1": 3, "01": 2}),
    ({"0": 3, "1": 3, "2": 3, "01": 1, "02": 1}, {"0": 1, "1": 2, "2": 2, "01": 1, "02": 1}),
    ({"0": 5, "1": 5, "01": 5}, {"01": 5}),
]


@pytest.mark.parametrize("inclusive, exclusive", VENN)
def test_venn(spark, inclusive, exclusive):
    def frame(x):
        return spark.createDataFrame([("g", list(k), v) for k, v in x.items()], "g string, region array<string>, time_us long")

    def read(df):
        return {"".join(r.region): r.time_us for r in df.collect()}

    assert read(rollup.venn_inclusive(frame(exclusive), ["g"])) == inclusive
    assert read(rollup.venn_exclusive(frame(inclusive), ["g"], 3)) == exclusive


def test_subplot_total(spark):
    df = spark.createDataFrame([("g", ["CPU"], 4951987256), ("g", ["GPU"], 22915662), ("g", ["CPU", "GPU"], 19313474)], "g string, resources array<string>, time_us long")
    assert {r.resource: r.time_us for r in rollup.subplot_from_overlap(df, ["g"]).collect()}["Total"] == 4955589444


def test_overhead_places(spark):
    df = events(spark, [("f", 10, 20), ("g", 30, 40)]).withColumn("category", F.lit("CUDA API CPU"))
    out = overhead.inject(df, overhead.Calibration(cupti={"f": 0.5}, interception=-1.0))
    got = sorted((r.category, r.event_name, r.start_ps, r.end_ps) for r in out.filter("category like 'Prof%'").collect())
    assert got == [("Profiling: CUPTI", "f", 10000, 10500), ("Profiling: LD_PRELOAD", "f", 20000, 20000), ("Profiling: LD_PRELOAD", "g", 40000, 40000)]


def test_poisoned_sum_and_histogram(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "g int, x long")
    assert dict(df.groupBy("g").agg(stats.poisoned_sum(F.col("x"))).collect()) == {1: None, 2: 7}
    hist = {r.bin: r.n for r in stats.histogram(df.filter("x is not null"), "x", 2).collect()}
    assert hist == {0: 0, 1: 0}  # bins begin at 0: both values lie beyond the last edge


def test_empty_trace(spark):
    empty = events(spark, []).withColumn("category", F.lit("GPU"))
    assert sweep.region_times(empty).count() == flatten.flatten_ops(empty).count() == sweep.merge_adjacent(empty, ["key"]).count() == 0


def test_shards(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "category_events.1.json").write_text('{"process_name":"p","phase":"x","machine_name":"m","category_events":{"Python":{"events":[{"thread_id":1,"start_time_us":5,"duration_us":3,"name":"f"},{"thread_id":1,"start_time_us":9,"duration_us":-2,"name":"g"}]}}}')
    (tmp_path / "a" / "cuda_device_events.1.json").write_text('{"process_name":"p","phase":"x","machine_name":"m","dev_events":{"0":{"device_name":"g0","events":[{"name":" ","cuda_event_type":"MEMCPY","start_time_us":1,"duration_us":2}]}}}')
    rows = shards.category_events(shards.read_shards(spark, str(tmp_path), "category_events")).orderBy("start_us").collect()
    assert [(r.category, r.event_name, r.start_us, r.end_us) for r in rows] == [("Python", "f", 5, 8), ("Python", "g", 9, 9)]
    gpu = shards.device_events(shards.read_shards(spark, str(tmp_path), "cuda_device_events")).first()
    assert (gpu.category, gpu.event_name, gpu.device) == ("GPU", "Memcpy", "g0")


def test_trace_csv(spark, tmp_path):
    """Each file's own header says where its columns are, and its units what they mean."""
    (tmp_path / "api.csv").write_text('==1== a profile\n"Start","Duration","Name","Correlation_ID"\nus,us,,\n1.6,2.0,k1,7\n5.0,-3.0,k2,8\n')
    (tmp_path / "gpu.csv").write_text('"Start","Duration","Grid X","Device","Name"\nms,us,,,\n0.002,4,8,"dev, (0)","void f<int, 4>(int)"\n')
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = shards.trace_csv(spark, str(tmp_path), {"Device": "device"}).orderBy("start_us", "event_name").collect()
    assert [tuple(r)[1:] for r in rows] == [("k1", 2, 4, None), ("void f<int, 4>(int)", 2, 6, "dev, (0)"), ("k2", 5, 5, None)]
    assert [tuple(r) for r in shards.csv_summary(shards.gpu_trace_csv(spark, str(tmp_path / "api.csv"))).orderBy("event_name").collect()] == [("k1", 1, 2, 2.0, 2, 2), ("k2", 1, 0, 0.0, 0, 0)]


def test_venn_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", "p", "x", ["A"], 5), ("m", "p", "x", ["B"], 4), ("m", "p", "x", ["A", "B"], 2)], "machine string, process string, phase string, region array<string>, time_us long")
    sinks.write_venn(sinks.venn_documents(df, ["machine", "process", "phase"], "ResourceOverlap"), ["machine", "process", "phase"], str(tmp_path / "v"))
    back = shards.venn_rows(spark, f"{tmp_path}/v/*/*/*/")
    assert {"".join(r.region): r.size for r in back.collect()} == {"A": 5, "B": 4, "AB": 2}


def test_live_bins_equal_batch(spark, tmp_path):
    from spanweave.operators.timeseries import busy_bins

    day = 86_400_000_000
    df = events(spark, [("a", day, day + 25), ("a", day + 12, day + 13), ("b", day + 40, day + 55)])
    df.write.parquet(str(tmp_path / "in"))
    schema = "machine string, process string, phase string, key string, event_name string, event_id long, start_us long, end_us long"
    bins = live.live_busy_bins(live.arriving_events(spark, str(tmp_path / "in"), schema), ["key"], 10)
    stream = bins.writeStream.format("memory").queryName("live_bins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted(spark.table("live_bins").collect()) == sorted(busy_bins(df, ["key"], 10).collect())


def plain_owners(spans):
    """For each instant the active span with the smallest end, of equal ends the latest start, as runs."""
    out = []
    for t in range(min(a for _, a, _ in spans), max(b for _, _, b in spans)):
        active = [(b, -a, k, i) for i, (k, a, b) in enumerate(spans) if a <= t < b]
        if active:
            owner = min(active)[3]
            if out and out[-1][0] == owner and out[-1][2] == t:
                out[-1][2] = t + 1
            else:
                out.append([owner, t, t + 1])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("bucket", [1, 3, 8, 64, None])
def test_flatten_as_plain_version(spark, bucket):
    rng = random.Random(8)
    spans = list({(s, s + rng.choice([1, 2, 5, 20, 90])): f"o{rng.randrange(4)}" for s in (rng.randrange(120) for _ in range(60))}.items())
    spans = [(k, a, b) for (a, b), k in spans]
    got = sorted((r.event_id, r.start_us, r.end_us) for r in flatten.flatten_ops(events(spark, spans), bucket=bucket).collect())
    assert got == plain_owners(spans)


@pytest.mark.parametrize("bucket", [1, 7, None])
def test_interval_joins_as_plain_version(spark, bucket):
    rng = random.Random(9)
    ops, evs = ([("x", s, s + rng.randrange(30)) for s in (rng.randrange(200) for _ in range(40))] for _ in range(2))
    got = sorted((r.op_id, r.event_id) for r in flatten.instances_with_events(events(spark, ops), events(spark, evs), bucket=bucket).collect())
    assert got == sorted((i, j) for i, (_, a, b) in enumerate(ops) for j, (_, c, d) in enumerate(evs) if a <= d and c <= b)
    live = [(i, a, b) for i, (_, a, b) in enumerate(ops) if b > a]
    bad = sorted((i, j) for i, a, b in live for j, c, d in live if a < c < b < d or ((a, b) == (c, d) and i < j))
    assert sorted((r.event_id, r.other_id) for r in flatten.bad_nesting(events(spark, ops), bucket=bucket).collect()) == bad


@pytest.mark.parametrize("bucket", [3, 40, None])
def test_sweep_with_many_keys(spark, monkeypatch, bucket):
    """Counting by name gives what columns give."""
    rng = random.Random(10)
    df = events(spark, [(f"k{rng.randrange(9)}", s, s + rng.randrange(25)) for s in (rng.randrange(150) for _ in range(80))])
    want = sorted(map(tuple, sweep.segments(df, bucket=bucket).collect()))
    monkeypatch.setattr(sweep, "MAX_KEYS", 3)
    assert sorted(map(tuple, sweep.segments(df, bucket=bucket).collect())) == want


def test_lookup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    big = spark.createDataFrame([(None if i % 3 == 0 else i % 700, i) for i in range(1500)], "k int, i int")
    small = spark.createDataFrame([(None, "none"), *((k, str(k)) for k in range(0, 700, 2))], "k int, v string")
    for how in ("left", "inner"):
        got = sorted(((r.k, r.i, r.v) for r in lineage.lookup(big, small, ["k"], how).collect()), key=lambda r: r[1])
        want = [(k, i, "none" if k is None else str(k) if k % 2 == 0 else None) for k, i in ((None if i % 3 == 0 else i % 700, i) for i in range(1500))]
        assert got == [w for w in want if how == "left" or w[2] is not None]


def test_interval_algebra_and_texts(spark):
    df = spark.createDataFrame([(0, 5, 3, 8), (0, 2, 3, 8), (3, 8, 3, 8), (9, 9, 3, 8)], "a long, b long, c long, d long")
    four = [F.col(c) for c in "abcd"]
    assert [r[0] for r in df.select(predicates.order(*four)).collect()] == ["overlap", "before", "equal", "after"]
    assert [r[0] and tuple(r[0]) for r in df.select(predicates.common_interval(*four)).collect()] == [(3, 5), None, (3, 8), None]
    assert tuple(df.select(predicates.merged_interval(*four)).first()[0]) == (0, 8)
    for kind, want in (("any", [True, False, True, False]), ("subsumes", [False, False, True, False]), ("partial", [True, False, False, False])):
        assert [r[0] for r in df.select(predicates.overlap(*four, kind)).collect()] == want
    texts = spark.createDataFrame([("1.5ms",), ("20us",), ("3 ns",), ("2s",), ("x",)], "t string")
    assert [r[0] for r in texts.select(predicates.human_micros(F.col("t"))).collect()] == [1500.0, 20.0, pytest.approx(0.003), 2e6, None]
    assert [r[0] for r in spark.createDataFrame([(0.25,), (7.0,), (1500.0,), (2.5e6,)], "u double").select(predicates.pretty_micros(F.col("u"))).collect()] == ["250.00 ns", "7.00 us", "1.50 ms", "2.50 s"]
    cast = predicates.numbers_where_possible(spark.createDataFrame([("1", "1.5", "x"), (None, "2", "3")], "a string, b string, c string"), ["a", "b", "c"])
    assert [t for _, t in cast.dtypes] == ["bigint", "double", "string"]
    index = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "kind string, level int")
    assert [tuple(r) for r in predicates.selected(index, {"kind": "a", "level": lambda c: c >= 1}, ["level"]).collect()] == [("a", 1), ("a", 2)]


def test_clamped_and_dropped(spark):
    df = events(spark, [("a", 5, 3), ("b", 1, 2)])
    assert [r.key for r in predicates.negative_dropped(df).collect()] == ["b"]
    assert sorted(r.end_us for r in predicates.negative_clamped(df).collect()) == [2, 5]
    names = spark.createDataFrame([("Intel Xeon",), ("GeForce",)], "d string")
    assert [r[0] for r in names.select(predicates.is_cpu(F.col("d"))).collect()] == [True, False]


def run_stream(spark, df, name, folder, mode="append"):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    stream.awaitTermination(180)
    return spark.table(name)


LIVE = "machine string, process string, phase string, key string, event_name string, event_id long, start_us long, end_us long"


def test_live_flatten_equals_batch(spark, tmp_path):
    """Operations come in several files; each piece comes out once, as in the batch, when the watermark has passed it."""
    second = 1_000_000
    spans = [("B", 0, 5), ("A", 1, 2), ("A", 3, 4), ("B", 6, 11), ("A", 7, 8), ("C", 7, 8), ("A", 9, 10), ("Z", 100, 101)]
    day = 86_400 * second  # times at the epoch itself count as late
    rows = [("m", "p", "x", k, k, i, day + a * second, day + b * second) for i, (k, a, b) in enumerate(spans)]
    for i, part in enumerate((rows[:2], rows[2:5], rows[5:7], rows[7:], [("m", "p", "x", "Y", "Y", 99, day + 200 * second, day + 201 * second)])):
        spark.createDataFrame(part, LIVE).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    spark.read.parquet(str(tmp_path / "in0")).limit(0).write.parquet(str(tmp_path / "all"))
    import shutil

    for i in range(5):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "all" / f"{i}-{f.name}")
            os.utime(tmp_path / "all" / f"{i}-{f.name}", (1_700_000_000 + i, 1_700_000_000 + i))
    ops = spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all")).withColumn("ts", F.timestamp_micros("start_us"))
    found = run_stream(spark, live.live_flatten(ops, ["process"], "8 seconds"), "live_flat", tmp_path / "c").collect()
    want = flatten.flatten_ops(spark.createDataFrame(rows, LIVE), ["process"]).filter(F.col("end_us") < day + 100 * second).collect()
    assert sorted(tuple(r) for r in found if r.end_us < day + 100 * second) == sorted(map(tuple, want))


def test_live_sums_and_progress(spark, tmp_path):
    hour = 3_600_000_000
    df = events(spark, [("a", hour, hour + 5), ("a", hour + 9, hour + 10), ("b", 2 * hour, 2 * hour + 7), ("a", 9 * hour, 9 * hour + 1)]).withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    df.write.parquet(str(tmp_path / "in"))
    stream = live.arriving_events(spark, str(tmp_path / "in"), LIVE + ", duration_us long")
    sums = run_stream(spark, live.live_category_time(stream, ["key"]), "live_sums", tmp_path / "c1", "update").collect()
    assert sorted((r.key, r.duration_us, r.n) for r in sums) == [("a", 1, 1), ("a", 6, 2), ("b", 7, 1)]
    last = run_stream(spark, live.live_last_progress(stream, ["key"], "start_us", "end_us"), "live_last", tmp_path / "c2", "complete").collect()
    assert sorted((r.key, r.end_us) for r in last) == [("a", 9 * hour + 1), ("b", 2 * hour + 7)]


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_quantiles_as_numpy(spark, monkeypatch, ranges):
    import numpy as np

    monkeypatch.setattr(stats, "RANGES", ranges)
    rng = random.Random(13)
    for values in ([5.0], [2.0, 2.0], [rng.choice([rng.random(), 3, 1e6]) for _ in range(101)], [float(rng.randrange(4)) for _ in range(50)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert stats.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1]) == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.9, 1]).tolist())
    assert stats.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_rows_without_a_partner_are_an_error(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "k string, rep int, v int")
    both = stats.row_by_row(left, left, ["k"], "rep", ("_x", "_y")).collect()
    assert sorted((r.row_id, r.v_x, r.v_y) for r in both) == [(1, 5, 5), (2, 6, 6)]
    with pytest.raises(Exception, match="more rows than the other"):
        stats.row_by_row(left, left.filter("rep = 1"), ["k"], "rep", ("_x", "_y")).collect()


def test_quantiles_leave_out_nan(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)] + [(float("nan"),), (None,)], "x double")
    assert stats.quantiles(df, "x", [0.5]) == [3.0]
    assert sorted(r.x for r in stats.without_outliers(df, "x").collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]

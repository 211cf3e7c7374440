"""Time buckets under uneven density, runs of bins and moving averages, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import calibration, flatten, ids, rollup, stats, timeseries
from spanweave.operators.grid import grid

rng = random.Random(3)
EVENTS = [("a" if rng.random() < 0.7 else "b", s, s + rng.choice([0, 1, 5, 30])) for s in [rng.randrange(600) for _ in range(40)]] + [("c", 5, 5)]


@pytest.mark.parametrize("far", [0, 10**12])
def test_buckets_hold_as_many_rows(spark, far):
    """Bursts at every scale, ties, a small group, and a row very far away."""
    times = [("a", 2**i + j % (2 ** (i // 2))) for i in range(30) for j in range(300)] + [("a", 7)] * 500 + [("b", 1), ("b", 1)] + [("a", far)]
    df = spark.createDataFrame(times, "g string, t long").repartition(3)
    found = grid(df, ["g"], "t", rows=20)
    assert len(found.levels) > 1  # more buckets than one level has
    rows = found.place(df, bucket="t").collect()
    assert len(rows) == len(times)
    for g in "ab":
        own = sorted((r.t, r.bucket) for r in rows if r.g == g)
        buckets = [b for _, b in own]
        assert buckets == sorted(buckets) and set(buckets) == set(range(max(buckets) + 1))
        for b in set(buckets):
            inside = [t for t, c in own if c == b]
            assert len(set(inside)) == 1 or len([t for t in inside if t not in (7, max(set(inside), key=inside.count))]) < 80
    other = spark.createDataFrame([("a", -5), ("a", 10**15), ("z", 1)], "g string, t long")
    last = max(r.bucket for r in rows if r.g == "a")
    assert sorted((r.t, r.bucket) for r in found.place(other, bucket="t").collect()) == [(-5, 0), (10**15, last)]


def test_interval_join_with_far_events(spark):
    """The result does not depend on where the buckets are: a burst, an event that holds all, and one a month later."""
    spans = [(i, i * 3, i * 3 + rng.choice([1, 4, 9])) for i in range(300)] + [(900, 0, 10**12), (901, 30 * 86_400 * 10**6, 30 * 86_400 * 10**6 + 5)]
    df = spark.createDataFrame([("m", "p", "x", i, f"n{i}", s, e) for i, s, e in spans], "machine string, process string, phase string, event_id long, event_name string, start_us long, end_us long")
    want = sorted((i, j) for i, s, e in spans for j, s2, e2 in spans if s <= e2 and s2 <= e)
    got = flatten.instances_with_events(df, df)
    assert sorted((r.op_id, r.event_id) for r in got.collect()) == want


@pytest.mark.parametrize("period, n", [(1, 5), (3, 7), (10, 100)])
def test_bins_as_plain(spark, period, n):
    df = spark.createDataFrame(EVENTS, "key string, start_us long, end_us long")
    busy = {}
    for k, s, e in EVENTS:
        busy.setdefault(k, set()).update(range(s // period, e // period + 1))
    assert sorted(map(tuple, timeseries.busy_bins(df, ["key"], period).collect())) == sorted((k, b) for k in busy for b in busy[k])
    shares = {(r.key, r.bin): r.util for r in timeseries.sliding_utilization(df, ["key"], period, n).collect()}
    assert shares == {(k, b): sum(c in busy[k] for c in range(b - n, b)) / n for k in busy for b in busy[k]}
    windows = [("a", 100, 400), ("b", 0, 900), ("d", 0, 50)]
    got = calibration.extended_bins(df, ["key"], spark.createDataFrame(windows, "key string, start_us long, end_us long"), period)
    assert sorted(map(tuple, got.collect())) == sorted((k, b, b in busy.get(k, ())) for k, lo, hi in windows for b in range(lo // period, hi // period + 1))


def test_a_day_is_one_run(spark):
    day = spark.createDataFrame([("a", 0, 86_400_000_000)], "key string, start_us long, end_us long")
    runs = timeseries.busy_runs(day, ["key"], 1000)
    assert [tuple(r) for r in runs.collect()] == [("a", 0, 86_400_000)]
    assert sorted(map(tuple, timeseries.sliding_runs(runs, ["key"], 12).collect())) == [("a", 0, 11, 0, 1), ("a", 12, 86_400_000, 12, 0)]


@pytest.mark.parametrize("rows", [20_000, 10])
def test_moving_average_over_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(timeseries, "grid", lambda df, by, t: grid(df, by, t, rows))
    samples = [("a", i * 7 % 1000 * rng.choice([1, 1, 50]), rng.random()) for i in range(300)] + [("b", 3, 1.0)]
    want = []
    for k in "ab":
        own = sorted((t, x) for g, t, x in samples if g == k)
        at, ema = own[0][0], 0.0
        for t, x in own:
            while t > at + 13:
                at += 13
                want.append((k, at, pytest.approx(ema)))
            ema = 0.9 * x + 0.1 * ema
    got = timeseries.moving_average(spark.createDataFrame(samples, "key string, t long, x double").withColumn("bucket", F.lit(1)), ["key"], 13, 0.9)
    assert sorted(map(tuple, got.collect())) == want


def plain_lanes(spans):
    """Lanes by the event that ended last; of equal ends the one whose event comes last by start, end and id."""
    ends, found = [], {}
    for start, end, i in sorted((s, max(s, e), i) for s, e, i in spans):
        free = [n for n, (e, _) in enumerate(ends) if e <= start]
        n = max(free, key=lambda n: (ends[n][0], ends[n][1])) if free else len(ends)
        ends[n : n + 1] = [(end, (start, end, i))]
        found[i] = n
    return found


@pytest.mark.parametrize("rows", [20_000, 6, 1])
def test_lanes_over_buckets(spark, monkeypatch, rows):
    """Bursts, ties, events without length and with a negative one, events that hold many buckets, and a far one."""
    monkeypatch.setattr(timeseries, "grid", lambda df, by, t: grid(df, by, t, rows))
    spans = [(k, s, s + rng.choice([0, 1, 4, 9, 60, 500, -2]), i) for i, (k, s) in enumerate((rng.choice("aab"), rng.randrange(300)) for _ in range(250))]
    spans += [("a", 0, 10**9, 900), ("a", 10**9, 10**9 + 5, 901), ("c", 3, 3, 902), (None, 1, 4, 903), (None, 2, 5, 904)]
    df = spark.createDataFrame([(k, i, s, e, 0) for k, s, e, i in spans], "key string, event_id long, start_us long, end_us long, lane int")
    got = {r.event_id: r.lane for r in timeseries.lanes(df, ["key"]).collect()}
    want = {}
    for key in ["a", "b", "c", None]:
        want |= plain_lanes([(s, e, i) for k, s, e, i in spans if k == key])
    assert got == want
    assert timeseries.lanes(df.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("ranges, few", [(2, 3), (5, 10), (256, 1)])
def test_quantiles_of_heavy_tails(spark, monkeypatch, ranges, few):
    import numpy as np

    monkeypatch.setattr(stats, "RANGES", ranges)
    monkeypatch.setattr(stats, "FEW", few)
    wanted = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    tails = [rng.paretovariate(0.2) for _ in range(300)] + [1e300, -1e300]
    for values in (tails, [7.0] * 200 + [8.0, 9.0, 1e12], [float(rng.randrange(3)) for _ in range(100)], [4.0]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        assert stats.quantiles(df, "v", wanted) == pytest.approx(np.quantile(values, wanted).tolist())


@pytest.mark.parametrize("most", [60, 3])
def test_superset_sums(spark, monkeypatch, most):
    """Both ways, against all pairs of sets: many labels, an empty set, labels that nothing has."""
    monkeypatch.setattr(rollup, "LATTICE_LABELS", most)
    names = [f"n{i}" for i in range(15)]
    have = {(g, tuple(sorted(rng.sample(names[: 15 if g == "a" else 2], rng.randrange(3))))): rng.randrange(9) for g in "ab" for _ in range(60)}
    have |= {("a", tuple(names)): 5, ("a", ()): 2, ("c", ()): 4}
    wanted = [*have, ("a", ("n1", "n14")), ("a", ("zz",)), ("d", ("n1",))]
    df = spark.createDataFrame([(g, list(s), v) for (g, s), v in have.items()], "g string, set array<string>, s long")
    got = rollup.superset_sums(df, spark.createDataFrame([(g, list(s)) for g, s in wanted], "g string, set array<string>"), ["g"])
    sums = {(g, s): [v for (h, t), v in have.items() if h == g and set(s) <= set(t)] for g, s in wanted}
    assert {(r.g, tuple(r.set)): r.s for r in got.collect()} == {k: sum(v) for k, v in sums.items() if v}
    sets = df.filter("size(set) > 0 and s > 0")
    there = rollup.venn_inclusive(sets, ["g"], "set", "s")
    back = rollup.venn_exclusive(there, ["g"], 15, "set", "s")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sets.collect()))


def test_ids_stay_over_loads(spark, tmp_path):
    def load(names):
        rows = ids.add_names(spark.createDataFrame([(n,) for n in names], "name string").repartition(3), f"{tmp_path}/names")
        return {r.name: r.id for r in rows.collect()}

    first = load(["b", "a", "b", None, ""])
    assert first == {"": 0, "a": 1, "b": 2}
    names = [f"n{i:03}" for i in range(200)]
    second = load(["a", *names, "0"])
    assert second == first | {n: 3 + i for i, n in enumerate(["0", *names])}
    assert load([]) == second == load(["b", None])

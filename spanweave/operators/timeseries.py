"""Time series: delays, bins of activity, sliding utilization, moving averages, lanes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.grid import following, grid
from spanweave.operators.sweep import merge_adjacent
from spanweave.plans.lineage import cut_lineage


def delays(events: DataFrame, by: list[str]) -> DataFrame:
    """Time from each event's end to the next one's start (by start, end): ``by, event_id, delay_us``; negative where they overlap."""
    rows = cut_lineage(events.select(*by, "event_id", "start_us", "end_us"))
    ordered = following(grid(rows, by, "start_us").place(rows, bucket="start_us"), by, [F.col("start_us"), F.col("end_us"), F.col("event_id")], "start_us", "next_start")
    return ordered.withColumn("delay_us", F.col("next_start") - F.col("end_us")).filter("delay_us is not null").select(*by, "event_id", "delay_us")


def delay_stats(delayed: DataFrame, by: list[str]) -> DataFrame:
    kind = F.when(F.col("delay_us") >= 0, "delay").otherwise("overlapped")
    return delayed.groupBy(*by, kind.alias("kind")).agg(F.avg("delay_us").alias("mean_us"), F.stddev_pop("delay_us").alias("std_us"), F.count("*").alias("n"))


#: Bins of a run that are given out by one row.
SPAN = 4096


def busy_runs(events: DataFrame, by: list[str], period: int) -> DataFrame:
    """Runs of neighbouring bins of width ``period`` (from the epoch) that events touch, ends included: ``by, first, last``. One row a run, however long."""
    touched = events.filter("end_us >= start_us").select(*by, F.floor(F.col("start_us") / period).alias("start_us"), (F.floor(F.col("end_us") / period) + 1).alias("end_us"))
    return merge_adjacent(touched, by).select(*by, F.col("start_us").alias("first"), (F.col("end_us") - 1).alias("last"))


def each_bin(runs: DataFrame, rest: list[str]) -> DataFrame:
    """A row for each bin of ``first`` to ``last``, with the ``rest`` of the columns; no array is longer than ``SPAN`` or the number of such."""
    parts = runs.withColumn("__at", F.explode(F.sequence("first", "last", F.lit(SPAN).cast("long"))))
    return parts.select(*rest, F.explode(F.sequence("__at", F.least(F.col("last"), F.col("__at") + SPAN - 1))).alias("bin"))


def busy_bins(events: DataFrame, by: list[str], period: int) -> DataFrame:
    """Bins of width ``period`` (from the epoch) that an event touches, ends included: ``by, bin``."""
    return each_bin(busy_runs(events, by, period), by)


def sliding_runs(runs: DataFrame, by: list[str], n: int) -> DataFrame:
    """Of each busy run, the parts along which the number of busy bins among the ``n`` before changes evenly.

    Returns ``by, first, last, busy, step``: before the bin ``first`` there are ``busy`` such bins, and ``step`` (-1, 0 or 1) more with
    each further bin. That number grows while a bin is busy and falls while the one n before was: a prefix sum over the ends of runs,
    in two steps by buckets of time, so that neither a process nor a long event is one task.
    """
    ends = [("first", 0, 1, 1), ("last", 1, -1, -1), ("first", n, -1, 0), ("last", n + 1, 1, 0)]
    marks = F.array(*[F.struct((F.col(c) + shift).alias("t"), F.lit(d).cast("long").alias("d"), F.lit(on).cast("long").alias("on")) for c, shift, d, on in ends])
    runs = cut_lineage(runs)
    each = runs.select(*by, F.explode(marks).alias("m")).select(*by, "m.t", "m.d", "m.on", (F.col("m.d") * F.col("m.t")).alias("dt"))
    at = grid(runs, by, "first").place(each, bucket="t").groupBy(*by, "bucket", "t").agg(*[F.sum(c).alias(c) for c in ("d", "on", "dt")])
    at = cut_lineage(at)
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*by, "bucket").agg(*[F.sum(c).alias(c) for c in ("d", "on", "dt")])
    carried = sums.select(*by, "bucket", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"c_{c}") for c in ("d", "on", "dt")])
    within = Window.partitionBy(*by, "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    now = at.join(carried, [*by, "bucket"]).withColumns({f"n_{c}": F.col(f"c_{c}") + F.sum(c).over(within) for c in ("d", "on", "dt")})
    ahead = following(now, by, [F.col("t")], "t", "next_t").filter("n_on > 0")
    return ahead.select(*by, F.col("t").alias("first"), (F.col("next_t") - 1).alias("last"), (F.col("t") * F.col("n_d") - F.col("n_dt")).alias("busy"), F.col("n_d").alias("step"))


def sliding_utilization(events: DataFrame, by: list[str], period: int, n: int) -> DataFrame:
    """For each busy bin, the share of the ``n`` bins strictly before it that are busy: ``by, bin, util``."""
    parts = sliding_runs(busy_runs(events, by, period), by, n)
    each = each_bin(parts, [*by, "first", "busy", "step"])
    return each.select(*by, "bin", ((F.col("busy") + F.col("step") * (F.col("bin") - F.col("first"))) / n).alias("util"))


def trace_percent(samples: DataFrame, by: list[str], time: str) -> DataFrame:
    """Adds ``trace_percent``: where between its group's first and last time a sample is."""
    ends = samples.groupBy(*by).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    return samples.join(ends, by).withColumn("trace_percent", F.try_divide((F.col(time) - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double"))).drop("__lo", "__hi")


def device_ids(samples: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Samples of equal time are devices 0, 1, … in the order in which they came: adds ``device_id, device``."""
    w = Window.partitionBy(*by, time).orderBy(order)
    numbered = samples.withColumn("device_id", F.row_number().over(w) - 1)
    return numbered.withColumn("device", F.format_string("%s.%02d", F.col("device_name"), F.col("device_id")))


def moving_average(samples: DataFrame, by: list[str], step_us: int, decay: float = 0.99) -> DataFrame:
    """An average that moves by ``decay`` towards each new sample, read off on a grid of ``step_us``.

    ``samples``: by, t, x, of equal times by x. The grid begins with the group's first sample; a point holds the average after all samples
    up to it, and is given out if a sample lies beyond it, so that the tail gives none. Returns ``by, t, ema``.

    What a run of samples makes of the average is an affine map; those of neighbouring runs compose. So each bucket of time is folded
    once from 0, the maps of the buckets (a row each) give the average at each one's begin, and the points between a bucket's samples and
    the next one's follow from there: a task holds a bucket, never a group.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = cut_lineage(samples.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")))
    dealt = cut_lineage(grid(rows, keys, "t").place(rows, bucket="t"))
    kinds = dict(rows.dtypes)
    group = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ema = 0.0
        for x in part.sort_values(["t", "x"])["x"]:
            ema = decay * x + (1 - decay) * ema
        return pd.DataFrame([(*key, len(part), ema, int(part["t"].min()))], columns=[*keys, "bucket", "n", "ema", "first_t"])

    maps = dealt.groupBy(*keys, "bucket").applyInPandas(total, f"{group}, bucket long, n long, ema double, first_t long")

    def carried(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, ema, before = part.sort_values("bucket"), 0.0, []
        for n, own in zip(part["n"], part["ema"], strict=True):
            before.append(ema)
            ema = own + (1 - decay) ** n * ema
        return part.assign(before=before, t0=part["first_t"].min(), next_t=part["first_t"].shift(-1).astype("Int64"))[[*keys, "bucket", "before", "t0", "next_t"]]

    begins = cut_lineage(maps.groupBy(*keys).applyInPandas(carried, f"{group}, bucket long, before double, t0 long, next_t long"))

    def points(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "x"])
        ema, t0, end = part["before"].iloc[0], int(part["t0"].iloc[0]), part["next_t"].iloc[0]
        times, values, out = part["t"].tolist(), part["x"].tolist(), []
        ahead = [*times[1:], None if pd.isna(end) else int(end)]
        for t, x, then in zip(times, values, ahead, strict=True):
            ema = decay * x + (1 - decay) * ema
            if then is not None:
                # The points that lie at or after this sample and before the next one, and after the first sample of all.
                first, last = max(1, -((t0 - t) // step_us)), -((t0 - then) // step_us) - 1
                if last >= first:
                    out.append((*key[: len(keys)], t0 + first * step_us, t0 + last * step_us, ema))
        return pd.DataFrame(out, columns=[*keys, "first", "last", "ema"]).astype({"first": "int64", "last": "int64", "ema": "float64"})

    given = dealt.join(begins, [*keys, "bucket"])
    runs = given.groupBy(*keys, "bucket").applyInPandas(points, f"{group}, first long, last long, ema double")
    out = runs.withColumn("__at", F.explode(F.sequence("first", "last", F.lit(SPAN * step_us).cast("long"))))
    out = out.withColumn("t", F.explode(F.sequence("__at", F.least(F.col("last"), F.col("__at") + (SPAN - 1) * step_us), F.lit(step_us).cast("long"))))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "t", "ema")


def lanes(events: DataFrame, by: list[str]) -> DataFrame:
    """A lane for each event such that no lane has overlapping ones: the one that ended last among those that are free.

    ``events``: by, event_id, start_us, end_us; adds ``lane``. Of lanes that ended at the same time the one whose event comes last by start,
    end and id is taken. An event that ends before it starts counts as one that ends at once. An empty table gives none.

    Free lanes are a stack: an event's end puts its lane on top, and a start takes the top one. So a bucket of time is worked on without
    knowing what was before: its starts take lanes that were freed in it, else the first, second, … of the stack as it was (numbered
    -1, -2, …); lanes of events that began earlier are named by these events (0, 1, …). What a bucket does is then told by what it
    takes off the stack, leaves on it, and hands on as active. Only these rows are folded in order of a group, streamed through a task.
    """
    keys = [f"k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    rows = cut_lineage(events.select(*named, "event_id", "start_us", "end_us", F.greatest("start_us", "end_us").alias("done_us"), F.monotonically_increasing_id().alias("uid")))
    placed = cut_lineage(grid(rows, keys, "start_us").place(rows, bucket="start_us", until="done_us"))
    kinds = dict(rows.dtypes)
    group = ", ".join(f"{k} {kinds[k]}" for k in keys)
    here = placed.withColumn("came", F.lit(False))
    later = placed.filter("until > bucket").withColumn("bucket", F.col("until")).withColumn("came", F.lit(True))

    def bucket_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        points = []
        for r in part.itertuples(index=False):
            rest = (r.done_us, r.event_id, r.uid)
            if not r.came:
                points.append((r.start_us, 1, *rest, 0))
            if r.came or r.until == r.bucket:
                points.append((r.done_us, 0, r.start_us, *rest[1:], 1) if r.done_us > r.start_us else (r.done_us, 1, *rest, 1))
        stack, taken, lane = [], 0, {uid: uid for uid in part.loc[part["came"], "uid"].tolist()}
        out = [(1, 0, uid, uid) for uid in lane]
        for *_, uid, ends in sorted(points):
            if ends:
                stack.append(lane[uid])
            elif stack:
                lane[uid] = stack.pop()
            else:
                taken += 1
                lane[uid] = -taken
        own = part.loc[~part["came"]]
        out += [(0, n, -n, -1) for n in range(1, taken + 1)]
        out += [(2, n, symbol, -1) for n, symbol in enumerate(stack)]
        out += [(3 if until > bucket else 4, 0, lane[uid], uid) for uid, until, bucket in zip(own["uid"], own["until"], own["bucket"], strict=True)]
        return pd.DataFrame([(*key, *o) for o in out], columns=[*keys, "bucket", "kind", "place", "symbol", "uid"])

    made = here.unionByName(later).groupBy(*keys, "bucket").applyInPandas(bucket_of, f"{group}, bucket long, kind int, place long, symbol long, uid long")
    made = cut_lineage(made)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, at, n, stack, active, now = None, None, 0, [], {}, {}
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if (mine := tuple(row[: len(keys)])) != group:
                    group, at, n, stack, active = mine, None, 0, [], {}
                if row.bucket != at:
                    at, now = row.bucket, {}
                if row.kind == 0:
                    if not stack:
                        stack.append(n)
                        n += 1
                    now[row.symbol] = stack.pop()
                elif row.kind == 1:
                    now[row.symbol] = active.pop(row.uid)
                elif row.kind == 2:
                    stack.append(now[row.symbol])
                else:
                    active[row.uid] = now[row.symbol]
                if row.kind < 2:
                    found.append((*mine, row.bucket, row.symbol, now[row.symbol]))
            yield pd.DataFrame(found, columns=[*keys, "bucket", "symbol", "lane"])

    told = made.filter("kind < 4").repartition(*keys).sortWithinPartitions(*keys, "bucket", "kind", "place")
    lane = told.mapInPandas(fold, f"{group}, bucket long, symbol long, lane long")
    lane = lane.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("bucket").alias("l_bucket"), F.col("symbol").alias("l_symbol"), "lane")
    known = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in [*keys, "bucket", "symbol"]]
    lanes_of = made.filter("kind > 2").join(lane, known).select("uid", "lane")
    return placed.join(lanes_of, "uid").select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "event_id", "start_us", "end_us", "lane")

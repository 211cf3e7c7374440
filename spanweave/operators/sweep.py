"""The multi-way overlap sweep: for every set of simultaneously active keys, how long it was active.

A trace can be one hot process, so time is cut into buckets and the count of active intervals is a prefix sum in
two steps: sums of a bucket's own boundaries within the bucket, plus the sum of all earlier buckets, of which there
is one row a bucket. No interval is copied into the buckets it spans, and no window runs over a whole trace's events.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.grid import ROWS, following, grid
from spanweave.plans.lineage import cut_lineage
from spanweave.sources.adapters import KEYS

#: Up to so many keys have a column each; with more, active keys are counted by name.
MAX_KEYS = 64
#: Boundaries that a task of the sweep gets, about.
TASK_MARKS = 200_000


def vocabulary(events: DataFrame, key: str = "key") -> list[str] | None:
    """All keys of the trace, sorted; None if there are more than ``MAX_KEYS``."""
    found = [r[0] for r in events.select(key).filter(F.col(key).isNotNull()).distinct().limit(MAX_KEYS + 1).collect()]
    return sorted(found) if len(found) <= MAX_KEYS else None


def _region(counts: list[Column], names: list[str]) -> Column:
    active = [F.when(c > 0, F.lit(n)) for c, n in zip(counts, names, strict=True)]
    return F.array_compact(F.array(*active)) if active else F.array().cast("array<string>")


def _marks(events: DataFrame, by: list[str], key: str, bucket: int | None) -> DataFrame:
    """``by, bucket, t, __key, d``: 1 at each start, -1 at each end."""
    live = events.filter((F.col("end_us") > F.col("start_us")) & F.col(key).isNotNull()).select(*by, F.col(key).alias("__key"), "start_us", "end_us")
    edges = F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d")))
    marks = live.select(*by, "__key", F.explode(edges).alias("e")).select(*by, "__key", "e.t", "e.d")
    return grid(live, by, "start_us", ROWS, bucket).place(marks, bucket="t")


def segments(events: DataFrame, by: list[str] | None = None, key: str = "key", bucket: int | None = None) -> DataFrame:
    """Every stretch of time between two neighbouring boundaries, with the keys active in it and in the stretch before.

    ``events`` has ``by``, ``key``, ``start_us``, ``end_us``. Intervals without a length, or with a null key or
    bound, count for nothing. Returns ``by``, ``start_us, end_us, region, previous`` (sorted arrays; empty in gaps;
    the first stretch follows an empty one). Buckets are of ``bucket`` µs, or of about as many boundaries each.
    """
    by = KEYS if by is None else by
    events = cut_lineage(events.select(*by, F.col(key).alias("__name"), "start_us", "end_us"))  # read for the keys, the grid and the sweep
    names, marks = vocabulary(events, "__name"), _marks(events, by, "__name", bucket)
    return _segments_by_name(marks, by) if names is None else _segments_by_column(marks, by, names or [""], 2 * events.count())  # an empty trace has no row anyway


def _segments_by_column(marks: DataFrame, by: list[str], names: list[str], n_marks: int) -> DataFrame:
    sums = [f"d{i}" for i in range(len(names))]
    steps = [F.sum(F.when(F.col("__key") == n, F.col("d")).otherwise(0)).alias(s) for n, s in zip(names, sums, strict=True)]
    # Not by bytes: marks compress well, and a task would get millions of them, each a row of all the sums.
    tasks = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_marks // TASK_MARKS))
    # Written out, as it is read for the totals and for the counts: Spark does not share the shuffle, and would place all marks twice.
    dealt = [F.col(c) for c in [*by, "bucket"]]
    at = cut_lineage(marks.repartition(tasks, *dealt).groupBy(*by, "bucket", "t").agg(*steps))

    order = Window.partitionBy(*by).orderBy("bucket")
    totals = at.groupBy(*by, "bucket").agg(F.min("t").alias("first_t"), *[F.sum(s).alias(s) for s in sums])
    carried = [F.coalesce(F.sum(s).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"c_{s}") for s in sums]
    carry = totals.select(*by, "bucket", F.lead("first_t").over(order).alias("next_t"), *carried)

    within = Window.partitionBy(*by, "bucket").orderBy("t")
    joined = at.repartition(tasks, *dealt).join(carry, [*by, "bucket"])
    now = [F.col(f"c_{s}") + F.sum(s).over(within.rowsBetween(Window.unboundedPreceding, 0)) for s in sums]
    counted = joined.select(*by, "t", F.coalesce(F.lead("t").over(within), "next_t").alias("end_us"), *sums, *[c.alias(f"n_{s}") for c, s in zip(now, sums, strict=True)])
    before = [F.col(f"n_{s}") - F.col(s) for s in sums]
    return counted.filter("end_us is not null").select(
        *by, F.col("t").alias("start_us"), "end_us", _region([F.col(f"n_{s}") for s in sums], names).alias("region"), _region(before, names).alias("previous")
    )


def _segments_by_name(marks: DataFrame, by: list[str]) -> DataFrame:
    """The same for any number of keys: a task counts the active keys of one bucket, told which are active at its begin."""
    groups = [f"k{i}" for i in range(len(by))]
    marks = cut_lineage(marks.select(*[F.col(c).alias(k) for c, k in zip(by, groups, strict=True)], "bucket", "t", "__key", F.col("d").cast("long").alias("d")))
    buckets = marks.groupBy(*groups, "bucket").agg(F.min("t").alias("first")).withColumn("next_t", F.lead("first").over(Window.partitionBy(*groups).orderBy("bucket")))
    own = Window.partitionBy(*groups, "__key").orderBy("bucket")
    totals = marks.groupBy(*groups, "__key", "bucket").agg(F.sum("d").alias("d"))
    runs = totals.select(*groups, "__key", F.sum("d").over(own).alias("d"), F.col("bucket").alias("b1"), F.lead("bucket").over(own).alias("b2")).filter("d > 0")
    # An active key goes to the buckets after its last change, up to that of its next.
    active = runs.withColumn("bucket", F.explode(F.sequence(F.col("b1") + 1, "b2"))).select(*groups, "bucket", F.lit(None).cast("long").alias("t"), "__key", "d")
    given = marks.select(*groups, "bucket", "t", "__key", "d").unionByName(active).join(buckets.select(*groups, "bucket", "next_t"), [*groups, "bucket"])

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for name, d in zip(part.loc[part["t"].isna(), "__key"], part.loc[part["t"].isna(), "d"], strict=True):
            counts[name] += d
        edges = part[part["t"].notna()].sort_values("t", kind="stable")
        times, rows = edges["t"].astype("int64").to_numpy(), list(zip(edges["__key"], edges["d"], strict=True))
        last, out, i = sorted(n for n, c in counts.items() if c > 0), [], 0
        while i < len(rows):
            t = times[i]
            while i < len(rows) and times[i] == t:
                counts[rows[i][0]] += rows[i][1]
                i += 1
            now = sorted(n for n, c in counts.items() if c > 0)
            out.append((t, times[i] if i < len(rows) else part["next_t"].iloc[0], now, last))
            last = now
        found = pd.DataFrame([r for r in out if not pd.isna(r[1])], columns=["start_us", "end_us", "region", "previous"])
        return found.assign(**dict(zip(groups, key[: len(groups)], strict=True)))[[*groups, *found.columns]]

    kinds = dict(marks.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in groups), "start_us long, end_us long, region array<string>, previous array<string>"])
    out = given.groupBy(*groups, "bucket").applyInPandas(fold, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, groups, strict=True)], "start_us", "end_us", "region", "previous")


def region_times(events: DataFrame, by: list[str] | None = None, key: str = "key", keep_empty: bool = False, bucket: int | None = None) -> DataFrame:
    """Total time, first start and last end of every region: ``by, region, time_us, min_start_us, max_end_us``."""
    by = KEYS if by is None else by
    found = segments(events, by, key, bucket)
    found = found if keep_empty else found.filter(F.size("region") > 0)
    return found.groupBy(*by, "region").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("time_us"), F.min("start_us").alias("min_start_us"), F.max("end_us").alias("max_end_us"))


def transitions(events: DataFrame, by: list[str] | None = None, key: str = "key", bucket: int | None = None) -> DataFrame:
    """How often each region follows another: ``by, previous, region, n``. Gaps and self-transitions count."""
    by = KEYS if by is None else by
    return segments(events, by, key, bucket).groupBy(*by, "previous", "region").agg(F.count("*").alias("n"))


def overlaps_with(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions that hold at least one of the keys."""
    return regions.filter(F.arrays_overlap("region", F.array(*map(F.lit, keys))))


def interval_starts(events: DataFrame, found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The events that begin with each stretch: ``by, start_us, end_us (of the stretch), event_id``."""
    by = KEYS if by is None else by
    starting = events.filter("end_us > start_us").select(*by, "start_us", "event_id")
    return found.select(*by, "start_us", "end_us").join(starting, [*by, "start_us"])


def merge_adjacent(events: DataFrame, by: list[str], bucket: int | None = None) -> DataFrame:
    """Union of the intervals of each ``by``: overlapping and touching ones become one. ``by, start_us, end_us``.

    The number of active intervals is a prefix sum over boundaries, as in the sweep; a run lasts from where it leaves 0
    to where it is 0 again.
    """
    live = cut_lineage(events.select(*by, F.lit("x").alias("__all"), "start_us", "end_us"))
    at = _marks(live, by, "__all", bucket).groupBy(*by, "bucket", "t").agg(F.sum("d").alias("d"))
    totals = at.groupBy(*by, "bucket").agg(F.sum("d").alias("d"))
    carry = totals.select(*by, "bucket", F.coalesce(F.sum("d").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    within = Window.partitionBy(*by, "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    counted = at.join(carry, [*by, "bucket"]).withColumn("n", F.col("carried") + F.sum("d").over(within))
    edges = counted.filter((F.col("n") == 0) != (F.col("n") == F.col("d"))).select(*by, "bucket", "t", "n")  # from 0 or to 0, but not both at once
    return following(edges, by, [F.col("t")], "t", "end_us").filter("n > 0").select(*by, F.col("t").alias("start_us"), "end_us")

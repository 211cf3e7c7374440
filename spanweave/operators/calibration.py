"""Calibration of profiling overhead from runs with and without it, training times, and what reports derive from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators import timeseries
from spanweave.operators.grid import grid, numbered
from spanweave.plans.lineage import cut_lineage, lookup


def overhead_or_none(pairs: DataFrame, longer: str, shorter: str, calls: str) -> DataFrame:
    """One row ``mean_us, std_us, n`` of ``(longer - shorter) / calls``; pairs without a call are left out, and if none is left all are 0."""
    each = F.when(F.col(calls) > 0, (F.col(longer) - F.col(shorter)) / F.col(calls))
    zero = F.lit(0.0)
    return pairs.agg(F.coalesce(F.avg(each), zero).alias("mean_us"), F.coalesce(F.stddev_pop(each), zero).alias("std_us"), F.count(each).alias("n"))


def overhead_of_series(plain: Column, loaded: Column, calls: Column) -> Column:
    """Overhead in µs a call of each repetition, from arrays of total seconds without and with it, and of calls."""
    each = F.arrays_zip(plain.alias("a"), loaded.alias("b"), calls.alias("n"))
    return F.transform(each, lambda x: (x["b"] - x["a"]) * 1e6 / x["n"])


def per_iteration(runs: DataFrame, by: list[str], total: str, calls: str, iterations: str) -> DataFrame:
    """Time a call and a training iteration of each setting, over its repetitions: means and population deviations."""
    call, turn = F.try_divide(F.col(total).cast("double"), F.col(calls).cast("double")), F.try_divide(F.col(total).cast("double"), F.col(iterations).cast("double"))
    kinds = {"us_per_call": call, "us_per_iteration": turn}
    return runs.groupBy(*by).agg(*[f(x).alias(f"{k}_{n}") for n, x in kinds.items() for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def training_times(progress: DataFrame) -> DataFrame:
    """Adds ``training_us, percent_complete, iterations, extrapolated_us, timesteps_per_sec, total_sec`` to progress rows.

    A part that is not between 0 and 1 gives no extrapolated time.
    """
    length, done = F.col("end_training_time_us") - F.col("start_training_time_us"), F.col("end_num_timesteps") - F.col("start_num_timesteps")
    part = F.try_divide(done.cast("double"), F.col("total_timesteps").cast("double"))
    rate = F.try_divide(done.cast("double"), length / 1e6)
    return progress.withColumns(
        {
            "training_us": length,
            "percent_complete": part,
            "iterations": done,
            "extrapolated_us": F.when(part.between(0, 1), F.try_divide(length.cast("double"), part)),
            "timesteps_per_sec": rate,
            "total_sec": F.try_divide(F.col("total_timesteps").cast("double"), rate),
        }
    )


def overhead_percent(times: DataFrame, by: list[str], config: str, baseline: str, value: str) -> DataFrame:
    """Every configuration's ``value`` against the baseline's of the same setting: ``by, config, value, baseline, percent``; null without a baseline."""
    base = times.filter(F.col(config) == baseline).groupBy(*by).agg(F.max(value).alias("baseline"))
    others = times.filter(F.col(config) != baseline).join(base, by, "left")
    return others.select(*by, config, value, "baseline", F.try_divide(100.0 * (F.col(value) - F.col("baseline")), F.col("baseline").cast("double")).alias("percent"))


def training_table(times: DataFrame, by: list[str], config: str, value: str) -> DataFrame:
    """Training time of each setting and configuration over its repetitions: ``mean, std`` (population) and ``n``."""
    return times.groupBy(*by, config).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def breakdown(sizes: DataFrame, by: list[str], totals: DataFrame, size: str = "time_us") -> DataFrame:
    """Each region's percent of its group's sum, and that share of the group's uninstrumented time (``totals``: by, total_sec; null if missing)."""
    sums = sizes.groupBy(*by).agg(F.sum(size).alias("__sum"))
    shares = sizes.join(sums, by).withColumn("percent", F.try_divide(100.0 * F.col(size), F.col("__sum"))).drop("__sum")
    return shares.join(totals, by, "left").withColumn("uninstrumented_sec", F.col("percent") / 100 * F.col("total_sec"))


def split_by_call(calls: DataFrame, by: list[str], turns: int, discard_first: bool = False) -> DataFrame:
    """Statistics of the calls of a function that are alike: ``by, call, n, sum_us, min_us, avg_us, std_us`` (population).

    ``turns`` is how often the code that calls it ran. If a function's calls (by start) can be divided by that, the i-th call
    of every turn is one kind; else all are one. ``discard_first`` leaves out the first call of each kind.
    """
    spans = cut_lineage(calls.select(*by, "event_id", "start_us", "end_us"))
    order = [F.col("start_us"), F.col("end_us"), F.col("event_id")]
    rows = numbered(grid(spans, by, "start_us").place(spans, bucket="start_us"), by, order, "i")
    counts = calls.groupBy(*by).agg(F.count("*").alias("total"))
    kinds = F.when(F.col("total") % turns == 0, F.floor(F.col("total") / turns)).otherwise(F.lit(1))
    rows = rows.join(counts, by).withColumn("kinds", kinds.cast("long")).withColumn("call", (F.col("i") - 1) % F.col("kinds"))
    rows = rows.filter(F.col("i") > F.col("kinds")) if discard_first else rows
    length = F.col("end_us") - F.col("start_us")
    return rows.groupBy(*by, "call").agg(F.count("*").alias("n"), F.sum(length).alias("sum_us"), F.min(length).alias("min_us"), F.avg(length).alias("avg_us"), F.stddev_pop(length).alias("std_us"))


def counts_of_kinds(events: DataFrame, process_op: Column) -> DataFrame:
    """One row: intercepted calls of both kinds, operations, operations that stand for a process, all rows, and whether they add up.

    Each intercepted call is recorded twice: as its native part and as the Python part around it.
    """
    category = F.col("category")
    found = events.agg(
        F.count_if(category == "Framework API C").alias("framework"),
        F.count_if(category == "Simulator C").alias("simulator"),
        F.count_if((category == "Operation") & ~process_op).alias("ops"),
        F.count_if((category == "Operation") & process_op).alias("process_ops"),
        F.count("*").alias("n_rows"),
    )
    return found.withColumn("adds_up", 2 * (F.col("framework") + F.col("simulator")) + F.col("ops") + F.col("process_ops") == F.col("n_rows"))


def python_shares(times: DataFrame, python: str, native: str, gpu: str) -> DataFrame:
    """Adds what Python costs: ``total, speedup`` (without Python), ``python_percent, gpu_percent, python_overhead_percent``; null where they divide by 0."""
    total = F.col(python) + F.col(native)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return times.withColumns({"total": total, "speedup": ratio(total, F.col(native)), "python_percent": ratio(100 * F.col(python), total), "gpu_percent": ratio(100 * F.col(gpu), total), "python_overhead_percent": ratio(100 * F.col(python), F.col(native))})


def ratios(times: DataFrame, by: list[str], config: str, above: str, below: str, value: str) -> DataFrame:
    """``value`` of one configuration over that of another, of the same ``by``: summed over what is left, ``by, ratio``; null where that is 0."""
    sums = times.filter(F.col(config).isin(above, below)).groupBy(*by).agg(*[F.sum(F.when(F.col(config) == c, F.col(value))).alias(n) for c, n in ((above, "a"), (below, "b"))])
    return sums.filter("a is not null and b is not null").select(*by, F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")).alias("ratio"))


def summarized(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``min, max, mean, geomean, std`` (sample) of a metric; values that are not above 0 have no geometric mean."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.exp(F.avg(F.ln(F.when(x > 0, x)))).alias("geomean"), F.stddev_samp(x).alias("std"))


def by_all_others(df: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation of one column, grouped by all the others."""
    return df.groupBy(*[c for c in df.columns if c != value]).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std"))


def heights(df: DataFrame, bar: list[str], part: list[str], value: str) -> DataFrame:
    """Heights of stacked bars: the mean of each part over its repetitions, then the sum of a bar's parts."""
    return df.groupBy(*bar, *part).agg(F.avg(value).alias("m")).groupBy(*bar).agg(F.sum("m").alias(value))


def extended_bins(events: DataFrame, by: list[str], windows: DataFrame, period: int) -> DataFrame:
    """Bins of the whole training time (``windows``: by, start_us, end_us) with whether events touch them: ``by, bin, busy``.

    Busy stretches of bins are rows, and so are the idle ones between them, until they are given out.
    """
    runs = timeseries.busy_runs(events, by, period)
    spans = windows.select(*by, F.floor(F.col("start_us") / period).alias("lo"), F.floor(F.col("end_us") / period).alias("hi"))
    inside = lookup(runs, spans, by, "inner").select(*by, F.greatest("first", "lo").alias("first"), F.least("last", "hi").alias("last"), "lo", "hi").filter("first <= last")
    inside = cut_lineage(inside)
    ahead = timeseries.following(grid(inside, by, "first").place(inside, bucket="first"), by, [F.col("first")], "first", "then")
    ends = inside.groupBy(*by).agg(F.min("first").alias("__first"))
    idle = ahead.select(*by, (F.col("last") + 1).alias("first"), (F.coalesce("then", F.col("hi") + 1) - 1).alias("last"))
    before = spans.join(ends, by, "left").select(*by, F.col("lo").alias("first"), F.coalesce(F.col("__first") - 1, F.col("hi")).alias("last"))
    rest = idle.union(before).filter("first <= last").withColumn("busy", F.lit(False))
    return timeseries.each_bin(inside.select(*by, "first", "last", F.lit(True).alias("busy")).unionByName(rest), [*by, "busy"]).select(*by, "bin", "busy")


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Names with their places in sorted order, from 0, each once. A report's names are few; they are ordered in one task."""
    return names.select(column).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1)


def legacy_venn(sizes: DataFrame, by: list[str], labels: str = "region", size: str = "time_us", near: float = 1e-8) -> DataFrame:
    """Old files, in which sets of several labels are exclusive but single ones hold all that they share: the exclusive sizes.

    From each single label all sets that hold it are taken off; what is then within ``near`` of 0 goes. ``sizes`` is read twice, so it
    is written out first: it may have a whole sweep behind it.
    """
    sizes = cut_lineage(sizes.select(*by, labels, size))
    signed = F.when(F.size(labels) == 1, F.col(size)).otherwise(-F.col(size))
    own = sizes.filter(F.size(labels) > 1).select(*by, labels, F.col(size).alias(size))
    single = sizes.select(*by, F.explode(labels).alias("x"), signed.alias("s")).groupBy(*by, "x").agg(F.sum("s").alias(size)).select(*by, F.array("x").alias(labels), size)
    return own.unionByName(single).filter(F.abs(F.col(size)) > near)


def composed(metrics: DataFrame, by: list[str], name: str, value: str, made: dict[str, dict[str, int]]) -> DataFrame:
    """Metrics made by adding (1) and taking off (-1) others of the same ``by``: ``by, name, value``; null if one is missing."""
    parts = sorted({p for m in made.values() for p in m})
    wide = metrics.groupBy(*by).agg(*[F.sum(F.when(F.col(name) == p, F.col(value))).alias(f"m{i}") for i, p in enumerate(parts)])
    sums = [F.struct(F.lit(n).alias(name), sum((F.col(f"m{parts.index(p)}") * k for p, k in m.items()), F.lit(0)).cast("double").alias(value)) for n, m in made.items()]
    return wide.select(*by, F.explode(F.array(*sums)).alias("x")).select(*by, "x.*")


def utilization_over_time(samples: DataFrame, by: list[str], time: str, util: str) -> DataFrame:
    """Seconds since the group's first sample, and utilization in percent: ``by, seconds, percent``."""
    first = samples.groupBy(*by).agg(F.min(time).alias("__first"))
    return samples.join(first, by).select(*by, ((F.col(time) - F.col("__first")) / 1e6).alias("seconds"), (100 * F.col(util)).alias("percent"))

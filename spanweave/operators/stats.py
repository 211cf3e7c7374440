"""Aggregates of reports: flattened statistics, histograms, shares, repetitions, calibration from paired runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flattened(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``{column}_min, _max, _mean, _std`` (sample) for each group."""
    out = []
    for c in columns:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*out)


def call_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sum, minimum, mean, standard deviation (population) and count."""
    return df.groupBy(*by).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


#: A range of values is split into so many at a time; one of at most ``FEW`` rows is put in order.
RANGES, FEW = 256, 100_000


def quantiles(df: DataFrame, value: str, wanted: list[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbours; None if there is no value. Nulls and NaN don't count.

    A range of values that holds a rank that is asked for is split at approximate quantiles of its own rows, and the parts are counted,
    until it has few rows or one value: far outliers and ties make no range larger, and no task orders more than ``FEW`` rows.
    """
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return [None for _ in wanted]
    ranks = sorted({f((n - 1) * q) for q in wanted for f in (math.floor, math.ceil)})
    # For each rank the range that holds it: its least and greatest value, the rows before it, and its own rows.
    homes = dict.fromkeys(ranks, (lo, hi, 0, n))

    def within(ranges: list[tuple], **more: list) -> DataFrame:
        rows = [(i, r[0], r[1], *[m[i] for m in more.values()]) for i, r in enumerate(ranges)]
        schema = ", ".join(["i int, lo double, hi double", *(f"{name} array<double>" for name in more)])
        return x.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), F.col("x").between(F.col("lo"), F.col("hi")))

    while large := sorted({h for h in homes.values() if h[0] < h[1] and h[3] > FEW}):
        points = [i / RANGES for i in range(1, RANGES)] or [0.5]
        above = F.min(F.when(F.col("x") > F.col("lo"), F.col("x")))
        found = within(large).groupBy("i", "lo").agg(F.percentile_approx("x", points, 4 * len(points)).alias("q"), above.alias("above")).collect()
        cuts = {r["i"]: sorted({r["above"], *(c for c in r["q"] if c > r["lo"])}) for r in found}
        part = F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        counted = within(large, cuts=[cuts[i] for i in range(len(large))]).groupBy("i", part.alias("part"))
        parts = sorted(counted.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect())
        for i, home in enumerate(large):
            before = home[2]
            for r in [r for r in parts if r["i"] == i]:
                for k in [k for k in ranks if homes[k] == home and before <= k < before + r["n"]]:
                    homes[k] = (r["lo"], r["hi"], before, r["n"])
                before += r["n"]
    at = {k: h[0] for k, h in homes.items() if h[0] == h[1]}
    if small := sorted({h for h in homes.values() if h[0] < h[1]}):
        some = within(small).groupBy("i", "x").agg(F.count("*").alias("c"))
        upto = some.withColumn("upto", F.sum("c").over(Window.partitionBy("i").orderBy("x")))
        asked = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(small.index(h)).alias("home"), F.lit(k - h[2]).alias("within")) for k, h in homes.items() if h in small])
        found = upto.withColumn("a", F.explode(asked)).filter("a.home = i and a.within < upto and a.within >= upto - c")
        at |= {r["rank"]: r["x"] for r in found.select("a.rank", "x").collect()}
    places = [(n - 1) * q for q in wanted]
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def without_outliers(df: DataFrame, value: str) -> DataFrame:
    """Rows within one and a half interquartile ranges around the quartiles (exact, linear interpolation); nulls and NaN are left out."""
    low, high = quantiles(df, value, [0.25, 0.75])
    if low is None:
        return df.limit(0)
    reach = 1.5 * (high - low)
    return df.filter(F.col(value).between(low - reach, high + reach))


def histogram(df: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    """Bins of equal width from 0 on; what is at or above the last edge is in none. ``bin, total_us, n, percent``.

    Where all values are alike the width is 0, and no value is in a bin.
    """
    edge = df.agg(F.ceil((F.max(value) - F.min(value)) / n_bins).alias("width"))
    counted = df.join(F.broadcast(edge)).withColumn("bin", F.floor(F.try_divide(F.col(value), F.col("width")))).filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    sums = counted.groupBy("bin").agg(F.sum(value).alias("total_us"), F.count("*").alias("n"))
    bins = df.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
    full = bins.join(sums, "bin", "left").select("bin", F.coalesce("total_us", F.lit(0)).alias("total_us"), F.coalesce("n", F.lit(0)).alias("n"))
    everything = full.agg(F.sum("total_us").alias("all_us"))
    return full.join(F.broadcast(everything)).select("bin", "total_us", "n", F.try_divide(100.0 * F.col("total_us"), F.col("all_us")).alias("percent"))


def repeated(summary: DataFrame, times: str) -> DataFrame:
    """Each summary row as often as it says."""
    return summary.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop("__i")


def poisoned_sum(value: Column) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def percent_within(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``percent``: the share of a row in its group's sum. The group sums are aggregated, then joined."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("__sum"))
    return df.join(sums, by).withColumn("percent", F.try_divide(100.0 * F.col(value), F.col("__sum"))).drop("__sum")


def mean_of_repetitions(df: DataFrame, by: list[str], repetition: str, value: str) -> DataFrame:
    """Sum in each repetition, then the mean of these."""
    return df.groupBy(*by, repetition).agg(F.sum(value).alias("s")).groupBy(*by).agg(F.avg("s").alias(value))


def row_by_row(left: DataFrame, right: DataFrame, by: list[str], order: str, suffixes: tuple[str, str]) -> DataFrame:
    """Joins the i-th rows of both sides in each group; the other columns get the suffixes. Groups are repetitions of one setting.

    A group of which one side has more rows than the other is an error when the result is read; a null group pairs with none, so it is one, too.
    """
    w = Window.partitionBy(*by)

    def numbered(df: DataFrame, suffix: str) -> DataFrame:
        rest = {c: c + suffix for c in df.columns if c not in by}
        return df.withColumnsRenamed(rest).withColumn("row_id", F.row_number().over(w.orderBy(order + suffix))).withColumn(f"__there{suffix}", F.lit(True))

    both = numbered(left, suffixes[0]).join(numbered(right, suffixes[1]), [*by, "row_id"], "full_outer")
    there = [F.coalesce(f"__there{x}", F.lit(False)) for x in suffixes]
    paired = F.assert_true(there[0] & there[1], "row_by_row: one side of a group has more rows than the other")
    return both.filter(paired.isNull()).drop(*[f"__there{x}" for x in suffixes])


def overhead_per_call(pairs: DataFrame, by: list[str], longer: str, shorter: str, calls: str) -> DataFrame:
    """Mean, population deviation and number of ``(longer - shorter) / calls``; pairs without a call are left out."""
    each = F.when(F.col(calls) > 0, (F.col(longer) - F.col(shorter)) / F.col(calls))
    found = pairs.withColumn("__o", each).filter("__o is not null")
    return found.groupBy(*by).agg(F.avg("__o").alias("mean_us"), F.stddev_pop("__o").alias("std_us"), F.count("__o").alias("n"))


def transition_categories(transitions: DataFrame) -> DataFrame:
    """New categories at transitions within one operation: ``op, category, n``.

    Both sides must have one and the same operation.
    """
    op = lambda c: F.filter(c, lambda x: x.startswith("op:"))
    same = (F.size(op("previous")) == 1) & (op("previous") == op("region"))
    new = F.filter(F.array_except("region", "previous"), lambda x: ~x.startswith("op:"))
    return transitions.filter(same).select(F.get(op("region"), F.lit(0)).alias("op"), F.explode(new).alias("category"), "n").groupBy("op", "category").agg(F.sum("n").alias("n"))


def last_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows with the greatest ``order`` of each group, alike ones once."""
    latest = df.groupBy(*by).agg(F.max(order).alias(order))
    return df.join(latest, [*by, order], "left_semi").distinct()


def metric_names(name: Column, names: dict[str, str]) -> Column:
    """A metric's name in another tool's scheme (``names``: from one to the other), whatever signs ``+`` and ``&`` end it; null if it has none there."""
    plain = F.regexp_replace(name, "[+&]+$", "")
    return F.coalesce(*[F.when(plain == k, v) for k, v in names.items()], F.lit(None).cast("string"))


def reattributed(ranges: DataFrame, percents: DataFrame) -> DataFrame:
    """Metrics of ``a/b/c`` ranges by operation: the range's metric times the percents of what lies at or below it.

    ``ranges``: range_name, metric, value. ``percents``: range_name, percent. Each range goes to all its prefixes.
    """
    path = F.split("range_name", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))
    below = percents.select(F.explode(prefixes).alias("range_name"), "percent").groupBy("range_name").agg(F.sum("percent").alias("percent"))
    return ranges.join(below, "range_name").withColumn("total", F.col("value") * F.col("percent"))

"""Profiling overhead: intervals injected at the places where it was spent, and totals to subtract."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.sources.adapters import KEYS, OPERATION, OVERHEADS

#: Inside, time is whole units of a thousandth of a microsecond, so that small overheads are kept.
SCALE = 1000


@dataclass(frozen=True)
class Calibration:
    """Mean overheads in microseconds a call; negative ones count as 0."""

    cupti: dict[str, float] = field(default_factory=dict)  # by API; others have none
    interception: float = 0.0
    annotation: float = 0.0
    framework: float = 0.0
    simulator: float = 0.0


def _units(micros: float) -> int:
    return int(max(0.0, micros) * SCALE)


def inject(events: DataFrame, means: Calibration) -> DataFrame:
    """The events, in units of 1/1000 µs (``start_ps, end_ps``), and five categories of overhead intervals.

    CUPTI: from the start of a calibrated API call. Interception of an API: from its end. Python to C: the second
    overhead's length after the end of the C event. Annotation: from the start of the raw operation.
    """
    start, end = F.col("start_us") * SCALE, F.col("end_us") * SCALE
    keep = [*KEYS, "event_name"]

    def spans(category: str, kind: str, lo: Column, hi: Column) -> DataFrame:
        return events.filter(F.col("category") == category).select(*keep, F.lit(kind).alias("category"), lo.alias("start_ps"), hi.alias("end_ps"))

    api, out = "CUDA API CPU", [events.select(*keep, "category", start.alias("start_ps"), end.alias("end_ps"))]
    if means.cupti:
        each = F.coalesce(*[F.when(F.col("event_name") == name, F.lit(_units(d))) for name, d in sorted(means.cupti.items())])
        out.append(spans(api, OVERHEADS[0], start, start + each).filter("end_ps is not null"))
    out.append(spans(api, OVERHEADS[1], end, end + _units(means.interception)))
    out.append(spans(OPERATION, OVERHEADS[2], start, start + _units(means.annotation)))
    for category, kind, d in (("Framework API C", OVERHEADS[3], means.framework), ("Simulator C", OVERHEADS[4], means.simulator)):
        out.append(spans(category, kind, end + _units(d), end + 2 * _units(d)))
    return reduce(DataFrame.unionByName, out)


def call_counts(events: DataFrame) -> DataFrame:
    """Calls that cost overhead, by process, operation or API: ``KEYS, kind, event_name, n``."""
    kind = F.when(F.col("category") == "CUDA API CPU", "api").when(F.col("category") == OPERATION, "annotation").when(F.col("category").isin("Framework API C", "Simulator C"), "interception")
    return events.withColumn("kind", kind).filter("kind is not null").groupBy(*KEYS, "kind", "event_name").agg(F.count("*").alias("n"))


def corrected_time(totals: DataFrame, counts: DataFrame, per_call: DataFrame, by: list[str]) -> DataFrame:
    """Total time less calls times calibrated overhead a call. APIs without a calibration cost nothing.

    ``totals``: by, total_us. ``counts``: by, api_name, n. ``per_call``: api_name, mean_us.
    """
    cost = counts.join(per_call, "api_name").groupBy(*by).agg(F.sum(F.col("n") * F.col("mean_us")).alias("overhead_us"))
    return totals.join(cost, by, "left").withColumn("overhead_us", F.coalesce("overhead_us", F.lit(0.0))).withColumn("corrected_us", F.col("total_us") - F.col("overhead_us"))


def melted(costs: DataFrame, by: list[str]) -> DataFrame:
    """Overhead columns in long format: ``by, overhead_type, overhead_us``."""
    rest = [c for c in costs.columns if c not in by]
    return costs.unpivot(by, rest, "overhead_type", "overhead_us")


def bias(times: DataFrame, by: list[str]) -> DataFrame:
    """Percent by which the mean corrected time is off the mean uninstrumented one (``kind``, ``time_us``)."""
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("time_us")))
    return times.groupBy(*by).agg(mean("corrected").alias("corrected_us"), mean("uninstrumented").alias("uninstrumented_us")).withColumn(
        "bias_percent", F.try_divide(100 * (F.col("corrected_us") - F.col("uninstrumented_us")), F.col("uninstrumented_us"))
    )

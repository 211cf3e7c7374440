"""Interval traces from plain tables: event tables as traces, paired runs, API statistics and progress rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the categories of a trace.
OPERATION, GPU = "Operation", "GPU"
CPU_CATEGORIES = ["Framework API C", "Python", "CUDA API CPU", "Simulator C", "Python profiler", "CPU"]
OVERHEADS = [
    "Profiling: CUPTI",
    "Profiling: LD_PRELOAD",
    "Profiling: Python annotation",
    "Profiling: Python->C interception TensorFlow",
    "Profiling: Python->C interception Simulator",
]

#: What a trace's rows belong to; the sweep and the reports run within one of these.
KEYS = ["machine", "process", "phase"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time-zone-free timestamp (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def trace_events(events: DataFrame) -> DataFrame:
    """A trace from an event table: the type gives the category, the value a duration in minutes."""
    k = F.get_json_object("props", "$.k").cast("long")
    types = {"click": "Python", "view": "Framework API C", "purchase": "CUDA API CPU", "error": GPU}
    category = F.coalesce(*[F.when(F.col("event_type") == t, c) for t, c in types.items()], F.lit(OPERATION))
    start, duration = micros(F.col("ts")), F.round(F.col("value") * 6e7).cast("long")
    name = F.when(category == OPERATION, F.concat(F.lit("op_"), k % 3)).otherwise(F.concat(F.lit("event_type_"), k % 5))
    return events.select(
        "event_id",
        F.lit("m0").alias("machine"),
        F.concat(F.lit("p"), F.col("user_id") % 4).alias("process"),
        F.lit("default_phase").alias("phase"),
        F.when(category == GPU, "gpu0").otherwise("cpu0").alias("device"),
        category.alias("category"),
        name.alias("event_name"),
        start.alias("start_us"),
        (start + duration).alias("end_us"),
        duration.alias("duration_us"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_events(table(spark, sf_dir, "events"))


#: The same adapter in DuckDB's SQL: a common table expression ``t``.
TRACE_SQL = """
t AS (
  SELECT event_id, 'm0' AS machine, 'p' || (user_id % 4) AS process, 'default_phase' AS phase,
    CASE event_type WHEN 'error' THEN 'gpu0' ELSE 'cpu0' END AS device,
    CASE event_type WHEN 'click' THEN 'Python' WHEN 'view' THEN 'Framework API C' WHEN 'purchase' THEN 'CUDA API CPU' WHEN 'error' THEN 'GPU' ELSE 'Operation' END AS category,
    CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN 'event_type_' || (k % 5) ELSE 'op_' || (k % 3) END AS event_name,
    epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 6e7) AS BIGINT) AS end_us, CAST(round(value * 6e7) AS BIGINT) AS duration_us
  FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
)"""

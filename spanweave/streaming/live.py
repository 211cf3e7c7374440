"""Live traces with Structured Streaming: activity bins and the latest progress while files arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanweave.operators.flatten import PROCESS_OP, pieces_of


def arriving_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of events as they come; ``ts`` is an event's start."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.timestamp_micros("start_us"))


def live_busy_bins(events: DataFrame, by: list[str], period: int, late: str = "10 minutes") -> DataFrame:
    """Bins that an event touches, each once; events later than ``late`` are left out. Equals the batch bins of what came in time."""
    touched = F.sequence(F.floor(F.col("start_us") / period), F.floor(F.col("end_us") / period))
    bins = events.withWatermark("ts", late).select(*by, F.explode(touched).alias("bin"), "ts")
    return bins.dropDuplicatesWithinWatermark([*by, "bin"]).select(*by, "bin")


def live_category_time(events: DataFrame, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sum of durations and number of events begun in each window."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, *by).agg(F.sum("duration_us").alias("duration_us"), F.count("*").alias("n")).select("window.start", *by, "duration_us", "n")


def live_last_progress(progress: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The value with the greatest ``order`` of each group so far."""
    return progress.groupBy(*by).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def live_flatten(ops: DataFrame, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Pieces of operations while they arrive (``by, event_id, event_name, start_us, end_us, ts``), as ``flatten_ops`` gives them.

    A piece comes out once no operation that is still to come can change it: when the watermark of starts (the latest less
    ``late``) has passed its end. Of each group only the operations that are not done by then are kept as state.
    """
    keys = [f"k{i}" for i in range(len(by))]
    live = ops.filter((F.col("end_us") > F.col("start_us")) & ~F.col("event_name").rlike(PROCESS_OP)).withWatermark("ts", late)
    rows = live.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "event_id", "event_name", "start_us", "end_us", "ts")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        for part in parts:
            waiting += [[int(i), n, int(s), int(e)] for i, n, s, e in zip(part["event_id"], part["event_name"], part["start_us"], part["end_us"], strict=True)]
        before = state.getCurrentWatermarkMs() * 1000
        found = [p for p in pieces_of(waiting) if until is None or p[3] > until]
        done = [[i, n, s if until is None else max(s, until), e] for i, n, s, e in found if e <= before]
        until = max([p[3] for p in done], default=until)
        waiting = [w for w in waiting if until is None or w[3] > until]
        if waiting:
            state.update((json.dumps([until, waiting]),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(w[3] for w in waiting) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([[*key, *d] for d in done], columns=[*keys, "event_id", "event_name", "start_us", "end_us"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "event_id long, event_name string, start_us long, end_us long"])
    out = rows.groupBy(*keys).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "event_id", "event_name", "start_us", "end_us")

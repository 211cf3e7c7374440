"""Readers of profilers' text summaries and inference logs, and of the tables of a profiler's database.

A report's lines belong together, so each file is one row that is split into numbered lines; reports are short.
"""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

NUMBER, TIME_UNIT = r"([0-9.]+)", "(s|ms|us|ns)"
#: The sections of a summary.
SUMMARY_SECTIONS = {"GPU activities": "gpu_activities", "API calls": "api_calls"}
#: What ends the time and level of a line of an inference log, its sections, and the units of its values.
LOG_LEVEL, LOG_SECTIONS, LOG_UNITS = "[I]", ["host latency", "gpu compute", "enqueue time"], ["ms", "s", "qps"]
#: Kinds of copies in a profiler's database.
COPY_KINDS = {1: "[CUDA memcpy HtoD]", 2: "[CUDA memcpy DtoH]", 8: "[CUDA memcpy DtoD]"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of every file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def with_section(lines: DataFrame, section: Column) -> DataFrame:
    """Adds ``section``: the last one named at or before each line of its file; lines before the first are left out."""
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(section, ignorenulls=True).over(so_far)).filter("section is not null")


def seconds(number: Column, unit: Column) -> Column:
    scale = F.when(unit == "s", 1.0).when(unit == "ms", 1e3).when(unit == "us", 1e6).when(unit == "ns", 1e9)
    return number.cast("double") / scale


def profile_summary(spark: SparkSession, path: str) -> DataFrame:
    """A profiler's text summary: one row for each kernel or API function.

    Returns ``path, section, time_percent`` (0 to 1), ``time_sec, calls, avg_sec, min_sec, max_sec, name``. Reports
    that ran into an error or saw no kernels have no rows.
    """
    title = F.nullif(F.regexp_extract("line", rf"^\s*({'|'.join(SUMMARY_SECTIONS)}):", 1), F.lit(""))
    section = F.coalesce(*[F.when(title == k, v) for k, v in SUMMARY_SECTIONS.items()])
    row = rf"^\s*(?:[^:]*:)?\s*{NUMBER}%\s+{NUMBER}{TIME_UNIT}\s+([0-9]+)\s+{NUMBER}{TIME_UNIT}\s+{NUMBER}{TIME_UNIT}\s+{NUMBER}{TIME_UNIT}\s+(.*\S)\s*$"
    found = with_section(numbered_lines(spark, path), section).filter(F.col("line").rlike(row))

    def part(i: int) -> Column:
        return F.regexp_extract("line", row, i)

    times = {"time_sec": 2, "avg_sec": 5, "min_sec": 7, "max_sec": 9}
    each = {name: seconds(part(i), part(i + 1)) for name, i in times.items()}
    return found.select("path", "section", (part(1).cast("double") / 100).alias("time_percent"), each["time_sec"].alias("time_sec"), part(4).cast("long").alias("calls"), *[each[n].alias(n) for n in ("avg_sec", "min_sec", "max_sec")], part(11).alias("name"))


def inference_log(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of an inference log: ``path, section, name, value``; of several values of one name the last.

    After a line's time and level comes a section's title, or a label and, behind a colon, a number and its unit. More may
    follow: the percentage of a percentile, and in brackets the value end to end, which is then the one that counts. Names are
    the label, the percentage and the unit.
    """
    lines = numbered_lines(spark, path).withColumn("body", F.trim(F.substring_index("line", LOG_LEVEL, -1)))
    section = F.when(F.lower("body").isin(*LOG_SECTIONS), F.translate(F.lower("body"), " ", "_"))
    metrics = with_section(lines, section).filter(F.instr("body", ": ") > 0)
    tokens = F.split(F.trim(F.translate(F.substr("body", F.instr("body", ": ") + 2), "()", "  ")), " +")
    words = metrics.select("path", "section", "line_no", F.lower(F.substring_index("body", ": ", 1)).alias("label"), tokens.alias("w"))
    at = F.when(F.array_position("w", "end") > 0, F.array_position("w", "end") + 2).otherwise(0).cast("int")  # "end to end", then the value
    percent = F.replace(F.get(F.filter("w", lambda x: x.endswith("%")), F.lit(0)), F.lit("%"), F.lit(""))
    parts = words.select("path", "section", "line_no", "label", percent.alias("percent"), F.get("w", at).try_cast("double").alias("value"), F.get("w", at + 1).alias("unit"))
    named = parts.filter(F.col("value").isNotNull() & F.col("unit").isin(*LOG_UNITS))
    name = F.concat_ws("_", F.translate("label", " ", "_"), "percent", "unit")
    return named.groupBy("path", "section", name.alias("name")).agg(F.max_by("value", "line_no").alias("value"))


#: Bytes of a database file for each of which a task reads a range of its rows, and ranges of a file at most: each of these tasks stages
#: the whole file, so with more of them for larger files what is copied would grow with the square of a file's size.
RANGE_BYTES, MOST_RANGES = 256 << 20, 16


@contextmanager
def _staged(uri: str) -> Iterator[sqlite3.Connection]:
    """A database of the shared store, copied piece by piece to a file of the task's own folder, which the database library can open."""
    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryDirectory() as folder:
        with store.open_input_stream(path) as source, open(f"{folder}/base", "wb") as copy:
            shutil.copyfileobj(source, copy, 4 << 20)
        base = sqlite3.connect(f"file:{folder}/base?mode=ro", uri=True)
        try:
            yield base
        finally:
            base.close()


def database_table(spark: SparkSession, path: str, table: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A table of a profiler's database files (SQLite): the columns of ``schema``; a file is read by a task for each ``range_bytes`` of it, by ``MOST_RANGES`` at most.

    Each such task stages the file on its disk, never in memory, and gives out the rows of its range of row ids in batches, so files
    may be of any size. Files without the table have no rows; a file that is no database is an error. Tables without row ids are not read.
    """
    wanted = spark.createDataFrame([], schema).schema
    columns = ", ".join(f'"{f.name}"' for f in wanted)
    kinds = to_arrow_schema(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                with _staged(part["path"]) as base:
                    if not base.execute("SELECT 1 FROM sqlite_master WHERE name = ?", [table]).fetchone():
                        continue
                    lo, hi = base.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
                    if lo is None:
                        continue
                    first, last = (lo + (hi - lo + 1) * n // part["parts"] for n in (part["part"], part["part"] + 1))
                    found = base.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ?', [first, last])
                    while got := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)

    parts = F.least(F.ceil(F.greatest(F.col("length"), F.lit(1)) / range_bytes), F.lit(MOST_RANGES)).cast("int")
    files = spark.read.format("binaryFile").load(path).select("path", parts.alias("parts"))
    ranges = files.select("path", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # A task a range, unless there are more of these than any cluster has use for; only the count comes to the driver.
    return ranges.repartition(max(1, min(ranges.count(), 10_000)), "path", "part").mapInArrow(rows, wanted)


def _micros(df: DataFrame, name: Column) -> DataFrame:
    return df.select(name.alias("event_name"), (F.col("start") / 1000).alias("start_us"), (F.col("end") / 1000).alias("end_us"), ((F.col("end") - F.col("start")) / 1000).alias("duration_us"))


def kernel_times(kernels: DataFrame, strings: DataFrame, *copies: DataFrame) -> DataFrame:
    """Kernels and copies of a profiler's database, in microseconds.

    ``kernels`` has ``start, end`` (ns) and ``name``, an id of ``strings`` (``_id_, value``); kernels without a name there
    are left out. ``copies`` are the tables of copies (``start, end, copyKind``); unknown kinds keep their number.
    The tables may come from any source that Spark reads.
    """
    named = kernels.select("start", "end", "name").join(strings.select(F.col("_id_").alias("name"), "value"), "name")
    out = _micros(named, F.col("value"))
    kind = F.coalesce(*[F.when(F.col("copyKind") == k, v) for k, v in COPY_KINDS.items()], F.col("copyKind").cast("string"))
    for table in copies:
        out = out.unionByName(_micros(table, kind))
    return out


def api_times(driver: DataFrame, runtime: DataFrame, names: DataFrame) -> DataFrame:
    """Calls of both programming interfaces (``start, end, cbid``), named by ``names`` (``cbid, name``), else by number."""
    calls = driver.select("start", "end", "cbid").unionByName(runtime.select("start", "end", "cbid"))
    named = calls.join(names.select("cbid", F.col("name").alias("known")), "cbid", "left")
    return _micros(named, F.coalesce("known", F.col("cbid").cast("string")))

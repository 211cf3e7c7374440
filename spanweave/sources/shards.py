"""Readers of trace shards: nested rows (JSON or Parquet) exploded to flat tables, and profilers' CSV and text files.

Files are chosen by name below a folder; Spark lists, splits and reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.plans.lineage import lookup

EVENT = "struct<thread_id:bigint,start_time_us:bigint,duration_us:bigint,name:string>"
GROUP = "process_name string, phase string, machine_name string"
#: File name patterns and the nested schema of each kind of shard.
SHARDS = {
    "category_events": ("category_events*", f"{GROUP}, category_events map<string,struct<events:array<{EVENT}>>>"),
    "cuda_device_events": ("cuda_device_events*", f"{GROUP}, dev_events map<string,struct<device_name:string,events:array<struct<name:string,cuda_event_type:string,start_time_us:bigint,duration_us:bigint>>>>"),
    "cuda_api_stats": ("cuda_api_stats*", f"{GROUP}, stats array<struct<tid:bigint,api_name:string,total_time_us:bigint,num_calls:bigint>>, events array<struct<tid:bigint,api_name:string,start_time_us:bigint,duration_us:bigint,active_operation:string>>"),
    "op_stack": ("op_stack*", f"{GROUP}, overhead_events map<string,struct<phase_overhead_events:map<string,struct<operation_name:string,num_overhead_events:bigint>>>>"),
    "machine_util": ("machine_util*", "machine_name string, device_util map<string,struct<device_name:string,samples:array<struct<start_time_us:bigint,util:float,total_resident_memory_bytes:bigint>>>>"),
    "training_progress": ("training_progress*", f"{GROUP}, content_code int, total_timesteps bigint, start_trace_time_us bigint, start_percent_complete float, start_num_timesteps bigint, start_training_time_us bigint, end_percent_complete float, end_training_time_us bigint, end_num_timesteps bigint"),
    "process": ("process_metadata*", f"{GROUP}, parent_process_name string, training_progress struct<content_code:int,percent_complete:float,num_timesteps:bigint,total_timesteps:bigint>"),
}


def file_kind(path: Column) -> Column:
    """Which kind of shard a path is, by the file's name; null for others."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(*[F.when(name.startswith(pattern.rstrip("*")), kind) for kind, (pattern, _) in SHARDS.items()])


def read_shards(spark: SparkSession, folder: str, kind: str, form: str = "json", names: str | None = None) -> DataFrame:
    """All shards of a kind below a folder, by the kind's file names or by ``names`` (a pattern)."""
    pattern, schema = SHARDS[kind]
    pattern = names or pattern
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"{pattern}.{form}").format(form).load(folder)


def _trace_rows(df: DataFrame, category: Column, name: Column, device: Column, event: str = "e") -> DataFrame:
    start, length = F.col(f"{event}.start_time_us"), F.col(f"{event}.duration_us")
    return df.select(
        F.col("machine_name").alias("machine"), F.col("process_name").alias("process"), "phase", device.alias("device"), category.alias("category"), name.alias("event_name"),
        start.alias("start_us"), (start + length).alias("end_us"), length.alias("duration_us"),
    )


def category_events(shards: DataFrame) -> DataFrame:
    """Maps of categories to events as one row an event. Negative lengths are made 0."""
    each = shards.select("*", F.explode("category_events").alias("c", "v")).withColumn("e", F.explode("v.events"))
    rows = _trace_rows(each, F.col("c"), F.col("e.name"), F.lit(None).cast("string"))
    return rows.withColumn("end_us", F.greatest("start_us", "end_us"))


def device_events(shards: DataFrame) -> DataFrame:
    """Events of devices as category ``GPU``; blank names become the type's name."""
    each = shards.select("*", F.explode("dev_events").alias("d", "v")).withColumn("e", F.explode("v.events"))
    name = F.coalesce(F.nullif(F.trim("e.name"), F.lit("")), F.initcap("e.cuda_event_type"))
    return _trace_rows(each, F.lit("GPU"), name, F.col("v.device_name"))


def api_events(shards: DataFrame) -> DataFrame:
    return _trace_rows(shards.withColumn("e", F.explode("events")), F.lit("CUDA API CPU"), F.col("e.api_name"), F.lit(None).cast("string"))


def api_stats(shards: DataFrame) -> DataFrame:
    each = shards.withColumn("s", F.explode("stats"))
    return each.select(F.col("machine_name").alias("machine"), F.col("process_name").alias("process"), "phase", "s.*")


def op_stack_counts(shards: DataFrame) -> DataFrame:
    each = shards.select("*", F.explode("overhead_events").alias("overhead_type", "o"))
    each = each.select("*", F.explode("o.phase_overhead_events").alias("overhead_phase", "p"))
    return each.select(F.col("machine_name").alias("machine"), F.col("process_name").alias("process"), "overhead_type", "overhead_phase", F.col("p.operation_name").alias("operation"), F.col("p.num_overhead_events").alias("n"))


def device_utilization(shards: DataFrame) -> DataFrame:
    each = shards.select("machine_name", F.explode("device_util").alias("d", "v")).select("machine_name", "v.device_name", F.posexplode("v.samples").alias("i", "s"))
    return each.select(F.col("machine_name").alias("machine"), "device_name", "i", F.col("s.start_time_us").alias("start_us"), F.col("s.util").cast("double").alias("util"), F.col("s.total_resident_memory_bytes").alias("rss_bytes"))


def training_progress(shards: DataFrame) -> DataFrame:
    """Progress rows with the group's columns as in a trace, and the time of training that each one spans."""
    rest = [c for c in shards.columns if c not in ("machine_name", "process_name", "phase", "content_code")]
    length = F.col("end_training_time_us") - F.col("start_training_time_us")
    return shards.select(F.col("machine_name").alias("machine"), F.col("process_name").alias("process"), "phase", *rest, length.alias("training_us"))


def process_metadata(shards: DataFrame) -> DataFrame:
    """Processes with their parents, and how far training had come when they ended."""
    return shards.select(F.col("machine_name").alias("machine"), F.col("process_name").alias("process"), "phase", F.col("parent_process_name").alias("parent"), "training_progress.percent_complete", "training_progress.num_timesteps", "training_progress.total_timesteps")


def run_configs(spark: SparkSession, folder: str, names: list[str], files: str = "*config.json") -> DataFrame:
    """A row for each run's configuration file below a folder: ``path`` and the named values of its ``metadata``; null where it has none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), *[F.get_json_object("value", f"$.metadata.{n}").alias(n) for n in names])


#: A cell of a line of CSV and the comma behind it; a quoted one may hold commas, and quotes as two.
CELL = r'\s*("(?:[^"]|"")*"|[^,]*)\s*,'
#: Times of a trace's CSV file are in these units, as its second row says.
UNITS = {"ns": 1e-3, "us": 1.0, "ms": 1e3, "s": 1e6}


def trace_csv(spark: SparkSession, path: str, more: dict[str, str] | None = None) -> DataFrame:
    """Traces in a profiler's CSV files, of devices or of API calls; the header of each file says what is where.

    Before the header there may be lines that begin with ``=``; after it comes a row of units. Quoted values may hold commas, and
    there may be any number of columns.
    ``more`` names further columns to keep: the header's name and the new one. Returns ``path, event_name, start_us, end_us``
    and those; times are rounded to µs, and negative lengths are 0. Files without the columns Start, Duration and Name have no
    rows. Spark splits large files; only headers and units, a row of each a file, are looked at first.
    """
    cells = F.transform(F.regexp_extract_all(F.concat("value", F.lit(",")), F.lit(CELL), 1), lambda c: F.trim(c))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    lines = spark.read.text(path).filter(~F.col("value").startswith("=") & (F.trim("value") != ""))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), plain.alias("c"))
    wanted = {"start": "Start", "duration": "Duration", "name": "Name"} | {new: old for old, new in (more or {}).items()}
    heads = lines.filter(F.array_contains("c", "Start") & F.array_contains("c", "Duration") & F.array_contains("c", "Name")).dropDuplicates(["path"])
    heads = heads.select("path", *[(F.array_position("c", old) - 1).cast("int").alias(f"at_{new}") for new, old in wanted.items()])
    placed = lookup(lines, heads, ["path"], "inner")
    first = F.get("c", F.col("at_start"))
    units = placed.filter(first.isin(*UNITS)).dropDuplicates(["path"]).select("path", *[F.get("c", F.col(f"at_{x}")).alias(f"unit_{x}") for x in ("start", "duration")])
    rows = lookup(placed.filter(first.try_cast("double").isNotNull()), units, ["path"])

    def micros(name: str) -> Column:
        scale = F.coalesce(*[F.when(F.col(f"unit_{name}") == u, x) for u, x in UNITS.items()], F.lit(1.0))
        return F.get("c", F.col(f"at_{name}")).try_cast("double") * scale

    start, end = F.round(micros("start")).cast("long"), F.round(micros("start") + F.coalesce(micros("duration"), F.lit(0.0))).cast("long")
    others = [F.when(F.col(f"at_{n}") >= 0, F.get("c", F.greatest(F.col(f"at_{n}"), F.lit(0)))).alias(n) for n in wanted if n not in ("start", "duration", "name")]
    return rows.select("path", F.get("c", F.col("at_name")).alias("event_name"), start.alias("start_us"), F.greatest(start, end).alias("end_us"), *others)


def gpu_trace_csv(spark: SparkSession, path: str) -> DataFrame:
    return trace_csv(spark, path).drop("path")


def csv_summary(rows: DataFrame) -> DataFrame:
    """Calls and times of each name of a trace: ``event_name, n, total_us, avg_us, min_us, max_us``."""
    length = F.col("end_us") - F.col("start_us")
    return rows.groupBy("event_name").agg(F.count("*").alias("n"), F.sum(length).alias("total_us"), F.avg(length).alias("avg_us"), F.min(length).alias("min_us"), F.max(length).alias("max_us"))


#: Fixed value: the type's name of a region's key in an overlap file.
KEY_TYPE = "CategoryKey"


def overlap_rows(spark: SparkSession, path: str) -> DataFrame:
    """Regions of overlap files whose values name their types: ``procs, ops, non_ops`` (sorted) and ``time_us``.

    Such a file is a dictionary, given as pairs of a key and a value. Keys of other types are left out.
    """
    files = spark.read.schema("typename string, key_value_pairs array<array<string>>").json(path, multiLine=True)
    pairs = files.filter("typename = 'dict'").select(F.explode("key_value_pairs").alias("p"))
    key = F.from_json(F.get("p", F.lit(0)), "typename string, procs array<string>, ops array<string>, non_ops array<string>")
    rows = pairs.select(key.alias("k"), F.get("p", F.lit(1)).try_cast("double").cast("long").alias("time_us")).filter(F.col("k.typename") == KEY_TYPE)
    return rows.select(*[F.array_sort(f"k.{c}").alias(c) for c in ("procs", "ops", "non_ops")], "time_us")


def hardware_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counters of named ranges; metric names without the signs that mark their kind."""
    rows = spark.read.csv(path, header=True, comment="#", schema="range_name string, metric_name string, metric_value double")
    return rows.withColumn("metric_name", F.regexp_replace("metric_name", "[+&]", ""))


def venn_rows(spark: SparkSession, path: str) -> DataFrame:
    """Sets of a Venn file with labels for indices; single sets name them. Those that are ``implied`` do only that, and are no rows."""
    schema = "metadata struct<machine:string,process:string,phase:string,overlap_type:string>, venn array<struct<sets:array<int>,size:double,label:string,implied:boolean>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    names = F.map_from_entries(F.transform(F.filter("venn", lambda v: v["label"].isNotNull()), lambda v: F.struct(F.get(v["sets"], F.lit(0)), v["label"])))
    each = files.select("metadata.*", names.alias("names"), F.explode("venn").alias("v")).filter("v.implied is not true")
    return each.select("machine", "process", "phase", "overlap_type", F.array_sort(F.transform("v.sets", lambda i: F.element_at("names", i))).alias("region"), F.col("v.size").alias("size"))


def path_attribute(path: Column, name: str) -> Column:
    """The value of ``name_value`` parts of paths, such as a repetition's number."""
    return F.nullif(F.regexp_extract(path, rf"(?:^|/|\.){name}_([^/.]+)", 1), F.lit(""))

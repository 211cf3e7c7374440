"""Scans and sinks on the driver's tables: files are written to the cluster's shared folder, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import ids, rollup, timeseries
from spanweave.plans.lineage import shared_folder
from spanweave.plans.queries import CLEAN_SQL, LANES_SQL, ORACLES, PLAIN_SQL, QUERIES, joined, keyed_regions, query
from spanweave.sources import reports, shards, sinks, wire
from spanweave.sources.adapters import TRACE_SQL, micros, table, trace

T = f"WITH {TRACE_SQL}"
DAY = 86_400_000_000
#: Rows of a database file, about, so that there are more files of a larger table and not larger ones.
FILE_ROWS = 1_000_000
#: Binary shards are put together into files of about so many bytes.
FILE_BYTES = 1 << 20


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, form: str = "json") -> DataFrame:
    """Nested rows of a kind of shard, written as JSON or as binary shards and read with that kind's schema."""
    path = folder(df.sparkSession)
    if form == "binary":
        wire.write_binary_shards(df, path, kind, FILE_BYTES)
        return wire.read_binary_shards(df.sparkSession, path, kind)
    df.write.json(path)
    return shards.read_shards(df.sparkSession, path, kind, names="part-*")


def both_forms(name: str, sql: str):
    """Registers a query of shards twice: read from JSON, and as ``{name}_binary`` from binary shards."""

    def register(f):
        query(name, sql)(f)
        query(f"{name}_binary", sql)(lambda spark, d: f(spark, d, "binary"))
        return f

    return register


def groups() -> list:
    return [F.col("machine").alias("machine_name"), F.col("process").alias("process_name"), "phase"]


@both_forms("s3_category_events", f"{T} SELECT process, category, event_name, start_us, end_us, duration_us FROM t WHERE end_us >= start_us")
def s3(spark, d, form="json"):
    return shards.category_events(written(sinks.shard_rows(trace(spark, d), DAY), "category_events", form)).select("process", "category", "event_name", "start_us", "end_us", "duration_us")


def api_shards(spark, d, form: str) -> DataFrame:
    """API calls and their statistics, a row for each process and day."""
    calls = trace(spark, d).filter("category = 'CUDA API CPU'")
    calls = sinks.with_part(calls, ["machine", "process", "phase"], F.floor(F.col("start_us") / DAY))
    event = F.struct(F.lit(0).cast("long").alias("tid"), F.col("event_name").alias("api_name"), F.col("start_us").alias("start_time_us"), F.col("duration_us"), F.lit("").alias("active_operation"))
    events = calls.groupBy(*groups(), "part").agg(F.collect_list(event).alias("events"))
    sums = calls.groupBy(*groups(), "part", "event_name").agg(F.sum("duration_us").alias("us"), F.count("*").alias("n"))
    stat = F.struct(F.lit(0).cast("long").alias("tid"), F.col("event_name").alias("api_name"), F.col("us").alias("total_time_us"), F.col("n").alias("num_calls"))
    stats = sums.groupBy("machine_name", "process_name", "phase", "part").agg(F.collect_list(stat).alias("stats"))
    return written(events.join(stats, ["machine_name", "process_name", "phase", "part"]).drop("part"), "cuda_api_stats", form)


@both_forms("s4_api_events", f"{T} SELECT process, category, event_name, start_us, end_us FROM t WHERE category = 'CUDA API CPU'")
def s4(spark, d, form="json"):
    return shards.api_events(api_shards(spark, d, form)).select("process", "category", "event_name", "start_us", "end_us")


@both_forms("s4_api_stats", f"{T} SELECT process, event_name AS api_name, CAST(sum(duration_us) AS BIGINT) AS total_time_us, CAST(count(*) AS BIGINT) AS num_calls FROM t WHERE category = 'CUDA API CPU' GROUP BY ALL")
def s4_stats(spark, d, form="json"):
    return shards.api_stats(api_shards(spark, d, form)).groupBy("process", "api_name").agg(F.sum("total_time_us").alias("total_time_us"), F.sum("num_calls").alias("num_calls"))


@both_forms("s5_device_events", f"{T} SELECT process, device, 'GPU' AS category, CASE WHEN event_id % 2 = 0 THEN 'Memcpy' ELSE event_name END AS event_name, start_us, end_us FROM t WHERE category = 'GPU'")
def s5(spark, d, form="json"):
    """Events with a blank name take their type's."""
    gpu = sinks.with_part(trace(spark, d).filter("category = 'GPU'"), ["machine", "process", "phase"], F.floor(F.col("start_us") / DAY))
    name = F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.col("event_name"))
    event = F.struct(name.alias("name"), F.lit("MEMCPY").alias("cuda_event_type"), F.col("start_us").alias("start_time_us"), F.col("duration_us"))
    lists = gpu.groupBy(*groups(), "part", "device").agg(F.collect_list(event).alias("events"))
    rows = lists.groupBy("machine_name", "process_name", "phase", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("device").alias("k"), F.struct(F.col("device").alias("device_name"), "events")))).alias("dev_events"))
    return shards.device_events(written(rows.drop("part"), "cuda_device_events", form)).select("process", "device", "category", "event_name", "start_us", "end_us")


def gpu_csv(spark, d) -> DataFrame:
    path = folder(spark)
    gpu = trace(spark, d).filter("category = 'GPU'")
    gpu.select(F.col("start_us").alias("Start"), F.col("duration_us").alias("Duration"), F.lit(8).alias("Grid X"), F.lit("dev, 0").alias("Device"), F.concat("event_name", F.lit("<int, 4>()")).alias("Name"), F.col("event_id").alias("Correlation_ID")).write.option("header", True).csv(path)
    return shards.trace_csv(spark, path, {"Correlation_ID": "id"})


@query("s6_trace_csv", f"{T} SELECT event_id, event_name || '<int, 4>()' AS event_name, start_us, end_us FROM t WHERE category = 'GPU'")
def s6(spark, d):
    return gpu_csv(spark, d).select(F.col("id").cast("long").alias("event_id"), "event_name", "start_us", "end_us")


@query("s7_csv_summary", f"{T} SELECT event_name || '<int, 4>()' AS event_name, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS total_us, avg(duration_us) AS avg_us, min(duration_us) AS min_us, max(duration_us) AS max_us FROM t WHERE category = 'GPU' GROUP BY 1")
def s7(spark, d):
    return shards.csv_summary(gpu_csv(spark, d))


@query("s8_kernel_times", "SELECT p_name AS event_name, l_partkey / 1000 AS start_us, (l_partkey + l_suppkey) / 1000 AS end_us, l_suppkey / 1000 AS duration_us FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 UNION ALL SELECT CASE l_linenumber WHEN 2 THEN '[CUDA memcpy DtoH]' WHEN 8 THEN '[CUDA memcpy DtoD]' ELSE CAST(l_linenumber AS VARCHAR) END, l_partkey / 1000, (l_partkey + l_suppkey) / 1000, l_suppkey / 1000 FROM lineitem WHERE l_linenumber IN (2, 3)")
def s8(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("copyKind"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("_id_"), F.col("p_name").alias("value"))
    return reports.kernel_times(rows.filter("l_linenumber = 1"), names, rows.filter("l_linenumber = 2"), rows.filter("l_linenumber = 3"))


@query("s8_database_files", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def s8_files(spark, d):
    """All of ``lineitem`` through database files: written by tasks, and each file read by several."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("double"), "l_returnflag")
    path = folder(spark)
    files = max(4, -(-rows.count() // FILE_ROWS))
    sinks.write_databases(rows.repartition(files, "l_orderkey"), path, "spans").agg(F.sum("n")).first()
    return reports.database_table(spark, path, "spans", "l_orderkey long, l_linenumber long, l_quantity double, l_returnflag string", range_bytes=64 << 10)


@query("s8_api_times", "SELECT coalesce(n_name, CAST(l_suppkey AS VARCHAR)) AS event_name, l_partkey / 1000 AS start_us, (l_partkey + 5) / 1000 AS end_us, 5 / 1000 AS duration_us FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey WHERE l_linenumber < 3")
def s8_api(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_partkey").alias("start"), (F.col("l_partkey") + 5).alias("end"), F.col("l_suppkey").alias("cbid"))
    return reports.api_times(rows.filter("l_linenumber = 1"), rows.filter("l_linenumber = 2"), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cbid"), F.col("n_name").alias("name")))


@both_forms("s10_utilization", "SELECT 'm' || (user_id % 2) AS machine, 'd' || (user_id % 3) AS device_name, epoch_us(ts) AS start_us, CAST(event_id % 101 AS DOUBLE) AS util, event_id AS rss_bytes FROM events")
def s10(spark, d, form="json"):
    sample = F.struct(micros(F.col("ts")).alias("start_time_us"), (F.col("event_id") % 101).cast("float").alias("util"), F.col("event_id").alias("total_resident_memory_bytes"))
    keys = [F.concat(F.lit("m"), F.col("user_id") % 2).alias("machine_name"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("device_name"), "part"]
    samples = sinks.with_part(table(spark, d, "events").withColumn("m", F.col("user_id") % 2), ["m"], F.date_trunc("day", "ts"))
    lists = samples.groupBy(*keys).agg(F.collect_list(sample).alias("samples"))
    rows = lists.groupBy("machine_name", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("device_name").alias("k"), F.struct("device_name", "samples")))).alias("device_util"))
    return shards.device_utilization(written(rows.drop("part"), "machine_util", form)).drop("i")


@query("s11_training_progress", "SELECT 'p' || (o_custkey % 4) AS process, CAST(o_orderkey AS BIGINT) AS total_timesteps, CAST(o_custkey AS BIGINT) AS training_us FROM orders")
def s11(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 4).alias("process_name"), F.lit("x").alias("phase"), F.lit("m").alias("machine_name"), F.col("o_orderkey").alias("total_timesteps"), F.lit(0).alias("start_training_time_us"), F.col("o_custkey").alias("end_training_time_us"))
    return shards.training_progress(written(rows, "training_progress")).select("process", "total_timesteps", "training_us")


@both_forms("s14_process_metadata", "SELECT c_name AS process, 'p' || (c_custkey % 5) AS parent, CAST(c_custkey AS BIGINT) AS num_timesteps, CAST(2 * c_custkey AS BIGINT) AS total_timesteps FROM customer")
def s14(spark, d, form="json"):
    state = F.struct(F.lit(0.5).alias("percent_complete"), F.col("c_custkey").alias("num_timesteps"), (2 * F.col("c_custkey")).alias("total_timesteps"))
    # Few bytes of much work each: Spark would read them in a task or two.
    customers = table(spark, d, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    rows = customers.select(F.col("c_name").alias("process_name"), F.lit("x").alias("phase"), F.lit("m").alias("machine_name"), F.concat(F.lit("p"), F.col("c_custkey") % 5).alias("parent_process_name"), state.alias("training_progress"))
    return shards.process_metadata(written(rows, "process", form)).select("process", "parent", "num_timesteps", "total_timesteps")


@both_forms("s13_op_stack", f"{T} SELECT process, category AS overhead_type, phase AS overhead_phase, event_name AS operation, count(*) AS n FROM t GROUP BY ALL")
def s13(spark, d, form="json"):
    counts = trace(spark, d).groupBy(*groups(), "category", "event_name").agg(F.count("*").alias("n"))
    one = F.create_map("phase", F.struct(F.col("event_name").alias("operation_name"), F.col("n").alias("num_overhead_events")))
    rows = counts.select("machine_name", "process_name", "phase", F.create_map("category", F.struct(one.alias("phase_overhead_events"))).alias("overhead_events"))
    return shards.op_stack_counts(written(rows, "op_stack", form)).drop("machine")


@query("s15_venn_round_trip", f"{PLAIN_SQL},{CLEAN_SQL} SELECT process, list_aggregate(res, 'string_agg', '+') AS region, CAST(sum(time_us) AS DOUBLE) AS size FROM u WHERE len(res) > 0 GROUP BY process, res")
def s15(spark, d):
    """Exclusive sizes, as a report has them, written as sets and read back."""
    sizes = rollup.resource_overlap(keyed_regions(spark, d)).select("process", F.col("resources").alias("region"), "time_us")
    path = folder(spark)
    sinks.write_venn(sinks.venn_documents(sizes.withColumns({"machine": F.lit("m0"), "phase": F.lit("x")}), ["machine", "process", "phase"], "ResourceOverlap"), ["machine", "process", "phase"], path)
    return joined(shards.venn_rows(spark, f"{path}/*/*/*/"), "region").select("process", "region", "size")


@query("s16_typed_json", f"{PLAIN_SQL} SELECT process AS procs, list_aggregate(ops, 'string_agg', '+') AS ops, list_aggregate(non_ops, 'string_agg', '+') AS non_ops, CAST(sum(time_us) AS BIGINT) AS time_us FROM r GROUP BY process, ops, non_ops")
def s16(spark, d):
    regions = keyed_regions(spark, d).select(F.array("process").alias("procs"), "ops", "non_ops", "time_us")
    path = folder(spark)
    sinks.overlap_document(regions).write.text(path)
    return joined(shards.overlap_rows(spark, path), "procs", "ops", "non_ops")


@query("s17_hardware_counters", "SELECT n_name AS range_name, 'dram_bytes' AS metric_name, CAST(n_nationkey AS DOUBLE) AS metric_value FROM nation")
def s17(spark, d):
    path = folder(spark)
    table(spark, d, "nation").select(F.col("n_name").alias("range_name"), F.lit("+dram_bytes&").alias("metric_name"), F.col("n_nationkey").cast("double").alias("metric_value")).write.option("header", True).csv(path)
    return shards.hardware_counters(spark, path)


@query("s18_run_configs", "SELECT r_name AS algo, CASE WHEN r_regionkey > 1 THEN 'e' || r_regionkey END AS env FROM region")
def s18(spark, d):
    path = folder(spark)
    values = F.struct(F.col("r_name").alias("algo"), F.when(F.col("r_regionkey") > 1, F.concat(F.lit("e"), F.col("r_regionkey"))).alias("env"))
    each = table(spark, d, "region").select(F.col("r_regionkey").alias("run"), F.to_json(F.struct(values.alias("metadata"))).alias("value"))
    each.repartition(5, "run").write.partitionBy("run").text(path)
    return shards.run_configs(spark, path, ["algo", "env"], "*.txt").select("algo", "env")


@query("s19_path_attributes", "SELECT s_suppkey AS id, CAST(s_suppkey % 7 AS VARCHAR) AS repetition, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS iterations FROM supplier")
def s19(spark, d):
    more = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/iterations_"), "s_suppkey")).otherwise("")
    paths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/runs/repetition_"), F.col("s_suppkey") % 7, more, F.lit("/x.json")).alias("path"))
    return paths.select("id", *[shards.path_attribute(F.col("path"), a).alias(a) for a in ("repetition", "iterations")])


@query("s2_file_kinds", "SELECT n_nationkey AS id, ['category_events', 'cuda_device_events', 'machine_util', NULL][1 + n_nationkey % 4] AS kind FROM nation")
def s2(spark, d):
    names = F.array(F.lit("category_events.1.json"), F.lit("cuda_device_events.json"), F.lit("machine_util.x"), F.lit("other.json"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), shards.file_kind(F.concat(F.lit("/a/b/"), F.element_at(names, F.col("n_nationkey") % 4 + 1))).alias("kind"))


@query(
    "q21_second_load",
    f"{T}, a AS (SELECT DISTINCT category AS name FROM t), b AS (SELECT DISTINCT event_name AS name FROM t WHERE event_name NOT IN (SELECT name FROM a)) SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM a UNION ALL SELECT name, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY name) - 1 FROM b",
)
def q21_second(spark, d):
    """Ids of categories, then of event names as a second load: ids that are given stay, new ones follow."""
    path = folder(spark)
    ids.add_names(trace(spark, d).select(F.col("category").alias("name")), path)
    return ids.add_names(trace(spark, d).select(F.col("event_name").alias("name")).union(trace(spark, d).select("category")), path)


@query("k1_events_parquet", f"{T} SELECT process, event_id, event_name, start_us, end_us FROM t")
def k1(spark, d):
    path = folder(spark)
    sinks.write_events(trace(spark, d), path)
    return spark.read.parquet(path).select(F.col("process").cast("string").alias("process"), "event_id", "event_name", "start_us", "end_us")


@query("k5_trace_viewer", LANES_SQL + " SELECT event_name AS name, 'X' AS ph, process AS pid, lane AS tid, start_us AS ts, end_us - start_us AS dur, category AS cat FROM m JOIN s USING (process, category, i)")
def k5(spark, d):
    path = folder(spark)
    sinks.chrome_events(timeseries.lanes(trace(spark, d), ["process", "category"]).join(trace(spark, d).select("event_id", "event_name"), "event_id")).write.text(path)
    return spark.read.schema("name string, ph string, pid string, tid long, ts long, dur long, cat string").json(path)


@query("k6_csv_report", f"{T} SELECT process, category, CAST(sum(duration_us) AS BIGINT) AS us FROM t GROUP BY ALL")
def k6(spark, d):
    path = folder(spark)
    sinks.write_csv(trace(spark, d).groupBy("process", "category").agg(F.sum("duration_us").alias("us")), path)
    return spark.read.schema("process string, category string, us long").option("header", True).csv(path)


@query("k8_shard_texts", f"{T} SELECT process, category, event_name, start_us, duration_us FROM t")
def k8(spark, d):
    """Binary shards as texts, a line each, which hold what the shards do: read back from the lines."""
    lines = wire.texts(written(sinks.shard_rows(trace(spark, d), DAY), "category_events", "binary"))
    back = lines.select(F.from_json("value", shards.SHARDS["category_events"][1]).alias("v")).select("v.*")
    each = back.select("process_name", F.explode("category_events").alias("category", "v")).select("process_name", "category", F.explode("v.events").alias("e"))
    return each.select(F.col("process_name").alias("process"), "category", F.col("e.name").alias("event_name"), F.col("e.start_time_us").alias("start_us"), "e.duration_us")


def intervals_by_csv(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Intervals through a CSV file; a region in which nothing runs is an empty text, not a null."""
    path = folder(spark)
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).options(header=True, nullValue="null").csv(path)


@query("k4_intervals", ORACLES["o5_intervals"])
def k4(spark, d):
    return intervals_by_csv(spark, QUERIES["o5_intervals"](spark, d))


@query("k4_interval_starts", ORACLES["o6_interval_starts"])
def k4_starts(spark, d):
    return intervals_by_csv(spark, QUERIES["o6_interval_starts"](spark, d))

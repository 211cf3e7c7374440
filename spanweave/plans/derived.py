"""Calibration, training times, ratios and the smaller operators on the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions import predicates as P
from spanweave.operators import calibration, flatten, rollup, stats, timeseries
from spanweave.plans.queries import BINS_SQL, CLEAN_SQL, FLAT_SQL, PAIR_SQL, PERIOD, PLAIN_SQL, SEGMENTS_SQL, joined, keyed_regions, ops_of, per_repetition, query, runs
from spanweave.sources.adapters import TRACE_SQL, micros, table, trace

T = f"WITH {TRACE_SQL}"
#: Training progress from orders: a process and configuration for each order, with the time and steps that it spans.
PROGRESS_SQL = """p AS (
  SELECT o_orderkey AS id, 'p' || (o_custkey % 4) AS process, CASE o_custkey % 3 WHEN 0 THEN 'uninstrumented' WHEN 1 THEN 'instrumented' ELSE 'no_cupti' END AS config, o_orderkey % 5 AS rep,
    epoch_us(o_orderdate) AS start_training_time_us, epoch_us(o_orderdate) + CAST(round(o_totalprice) AS BIGINT) * 1000 AS end_training_time_us,
    o_custkey % 10 AS start_num_timesteps, o_custkey % 10 + 1 + o_orderkey % 90 AS end_num_timesteps, CASE WHEN o_orderkey % 11 = 0 THEN 50 ELSE 100 END AS total_timesteps FROM orders)"""
TIMES_SQL = f"""WITH {PROGRESS_SQL}, q AS (SELECT *, end_training_time_us - start_training_time_us AS training_us, end_num_timesteps - start_num_timesteps AS iterations,
  (end_num_timesteps - start_num_timesteps)::DOUBLE / total_timesteps AS percent_complete FROM p),
x AS (SELECT *, CASE WHEN percent_complete BETWEEN 0 AND 1 AND percent_complete <> 0 THEN training_us::DOUBLE / percent_complete END AS extrapolated_us,
  CASE WHEN training_us <> 0 THEN iterations::DOUBLE / (training_us / 1e6) END AS timesteps_per_sec FROM q),
t AS (SELECT *, CASE WHEN timesteps_per_sec <> 0 THEN total_timesteps / timesteps_per_sec END AS total_sec FROM x)"""


def progress(spark, d) -> DataFrame:
    start = micros(F.col("o_orderdate"))
    config = F.when(F.col("o_custkey") % 3 == 0, "uninstrumented").when(F.col("o_custkey") % 3 == 1, "instrumented").otherwise("no_cupti")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_custkey") % 4).alias("process"), config.alias("config"), (F.col("o_orderkey") % 5).alias("rep"),
        start.alias("start_training_time_us"), (start + F.round("o_totalprice").cast("long") * 1000).alias("end_training_time_us"),
        (F.col("o_custkey") % 10).alias("start_num_timesteps"), (F.col("o_custkey") % 10 + 1 + F.col("o_orderkey") % 90).alias("end_num_timesteps"),
        F.when(F.col("o_orderkey") % 11 == 0, 50).otherwise(100).alias("total_timesteps"),
    )


@query("a7_training_times", TIMES_SQL + " SELECT id, training_us, percent_complete, iterations, extrapolated_us FROM t")
def a7(spark, d):
    return calibration.training_times(progress(spark, d)).select("id", "training_us", "percent_complete", "iterations", "extrapolated_us")


@query("c9_throughput", TIMES_SQL + " SELECT id, timesteps_per_sec, total_sec FROM t")
def c9_rate(spark, d):
    return calibration.training_times(progress(spark, d)).select("id", "timesteps_per_sec", "total_sec")


@query(
    "c9_projected_overhead",
    TIMES_SQL + """, l AS (SELECT process, config, max(total_sec) AS total_sec FROM t WHERE (process, config, end_training_time_us) IN (SELECT (process, config, max(end_training_time_us)) FROM t GROUP BY process, config) GROUP BY process, config),
b AS (SELECT process, total_sec AS baseline FROM l WHERE config = 'uninstrumented')
SELECT l.process, config, total_sec, baseline, 100.0 * (total_sec - baseline) / baseline AS percent FROM l LEFT JOIN b USING (process) WHERE config <> 'uninstrumented'""",
)
def c9_projected(spark, d):
    last = stats.last_by(calibration.training_times(progress(spark, d)), ["process", "config"], "end_training_time_us")
    return calibration.overhead_percent(last.groupBy("process", "config").agg(F.max("total_sec").alias("total_sec")), ["process"], "config", "uninstrumented", "total_sec")


@query("c10_training_table", TIMES_SQL + " SELECT process, config, avg(training_us) AS mean, stddev_pop(training_us) AS std, count(training_us) AS n FROM t GROUP BY process, config")
def c10(spark, d):
    return calibration.training_table(calibration.training_times(progress(spark, d)), ["process"], "config", "training_us")


@query(
    "c3_cupti_by_iterations",
    "SELECT l_linestatus AS config, l_returnflag AS api, l_orderkey % 3 AS iterations, avg(us / calls) AS mean_us_per_call, stddev_pop(us / calls) AS std_us_per_call, avg(us / (10.0 * (1 + l_orderkey % 3))) AS mean_us_per_iteration, stddev_pop(us / (10.0 * (1 + l_orderkey % 3))) AS std_us_per_iteration FROM (SELECT l_linestatus, l_returnflag, l_orderkey % 3 AS l_orderkey, l_suppkey % 5 AS rep, sum(round(l_extendedprice)) AS us, count(*) AS calls FROM lineitem GROUP BY ALL) GROUP BY ALL",
)
def c3(spark, d):
    keys = [F.col("l_linestatus").alias("config"), F.col("l_returnflag").alias("api"), (F.col("l_orderkey") % 3).alias("iterations")]
    each = table(spark, d, "lineitem").groupBy(*keys, (F.col("l_suppkey") % 5).alias("rep")).agg(F.sum(F.round("l_extendedprice")).alias("us"), F.count("*").alias("calls"))
    return calibration.per_iteration(each.withColumn("turns", 10 * (1 + F.col("iterations"))), ["config", "api", "iterations"], "us", "calls", "turns")


@query("c4_annotation", PAIR_SQL.format(g="", p="") + " SELECT coalesce(avg((x.us - y.us) / (x.calls * (i % 2))), 0) AS mean_us, coalesce(stddev_pop((x.us - y.us) / (x.calls * (i % 2))), 0) AS std_us, count((x.us - y.us) / (x.calls * (i % 2))) AS n FROM x JOIN y USING (i) WHERE i % 2 = 1")
def c4(spark, d):
    both = [per_repetition(runs(spark, d, s)).withColumn("all", F.lit(0)) for s in ("O", "F")]
    pairs = stats.row_by_row(*both, ["all"], "rep", ("_int", "_unins"))
    return calibration.overhead_or_none(pairs.withColumn("calls", F.col("calls_int") * (F.col("row_id") % 2)), "us_int", "us_unins", "calls")


@query("c4_no_calls", "SELECT 0.0::DOUBLE AS mean_us, 0.0::DOUBLE AS std_us, 0::BIGINT AS n")
def c4_none(spark, d):
    return calibration.overhead_or_none(per_repetition(runs(spark, d, "O")).withColumn("none", F.lit(0)), "us", "us", "none")


@query(
    "c5_microbenchmark",
    "WITH a AS (SELECT l_orderkey % 8 AS rep, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS loaded, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS plain, count(*) AS n FROM lineitem GROUP BY ALL) SELECT avg((loaded - plain) * 1e6 / n) AS mean_us, stddev_pop((loaded - plain) * 1e6 / n) AS std_us, count(*) AS n FROM a",
)
def c5(spark, d):
    sums = [F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))) for s in ("O", "F")]
    each = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("rep")).agg(sums[0].alias("loaded"), sums[1].alias("plain"), F.count("*").alias("n"))
    rows = each.agg(F.array_sort(F.collect_list(F.struct("rep", "loaded", "plain", "n"))).alias("r"))  # eight repetitions
    series = rows.select(*[F.col(f"r.{c}").alias(c) for c in ("loaded", "plain", "n")])
    found = series.select(F.explode(calibration.overhead_of_series(F.col("plain"), F.col("loaded"), F.col("n"))).alias("us"))
    return found.agg(F.avg("us").alias("mean_us"), F.stddev_pop("us").alias("std_us"), F.count("us").alias("n"))


@query(
    "c11_breakdown_uninstrumented",
    f"""{PLAIN_SQL},{CLEAN_SQL}, {PROGRESS_SQL}, z AS (SELECT process, list_aggregate(ops, 'string_agg', '+') AS op, list_aggregate(res, 'string_agg', '+') AS resources, sum(time_us) AS us FROM u WHERE len(res) > 0 GROUP BY process, ops, res),
m AS (SELECT process, avg(end_training_time_us - start_training_time_us) / 1e6 AS total_sec FROM p WHERE config = 'uninstrumented' GROUP BY process)
SELECT process, op, resources, 100.0 * us / sum(us) OVER (PARTITION BY process) AS percent, us / sum(us) OVER (PARTITION BY process) * total_sec AS uninstrumented_sec FROM z LEFT JOIN m USING (process)""",
)
def c11(spark, d):
    times = calibration.training_times(progress(spark, d)).filter("config = 'uninstrumented'").groupBy("process").agg((F.avg("training_us") / 1e6).alias("total_sec"))
    sizes = joined(rollup.operation_overlap(keyed_regions(spark, d)), "ops", "resources")
    return calibration.breakdown(sizes, ["process"], times).select("process", F.col("ops").alias("op"), "resources", "percent", "uninstrumented_sec")


@query("c12_normalised", f"{T} SELECT process, category, sum(duration_us) / 1e6 AS total_sec, 100.0 * sum(duration_us) / sum(sum(duration_us)) OVER (PARTITION BY process) AS percent FROM t GROUP BY process, category")
def c12(spark, d):
    sums = trace(spark, d).groupBy("process", "category").agg(F.sum("duration_us").alias("total_us"))
    return P.to_seconds(stats.percent_within(sums, ["process"], "total_us"))


@query(
    "c14_composed_metrics",
    "SELECT process, unnest(['busy', 'rest']) AS metric, unnest([a + b, a - b - c]) AS value FROM (SELECT 'p' || (l_suppkey % 4) AS process, sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 0) AS a, sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 1) AS b, sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 2) AS c FROM lineitem GROUP BY process)",
)
def c14(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_suppkey") % 4).alias("process"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("metric"), F.col("l_quantity").alias("value"))
    return calibration.composed(rows, ["process"], "metric", "value", {"busy": {"a": 1, "b": 1}, "rest": {"a": 1, "b": -1, "c": -1}})


@query("c16_metric_names", "SELECT replace(p_brand, '#', '_') AS metric, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY metric")
def c16(spark, d):
    """Two spellings of a metric's name, one with the signs that mark its kind, are one."""
    marked = table(spark, d, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("&")).alias("name"))
    return marked.select(F.regexp_replace("name", "[+&]", "").alias("metric")).groupBy("metric").agg(F.count("*").alias("n"))


@query("c17_utilization", "SELECT 'd' || (user_id % 3) AS device, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id % 3)) / 1e6 AS seconds, 100 * value AS percent FROM events")
def c17(spark, d):
    samples = table(spark, d, "events").select(F.concat(F.lit("d"), F.col("user_id") % 3).alias("device"), micros(F.col("ts")).alias("t"), "value")
    return calibration.utilization_over_time(samples, ["device"], "t", "value")


@query("q2_samples_of_device", "SELECT event_id, epoch_us(ts) AS t, value AS util FROM events WHERE user_id % 3 = 1 ORDER BY t, event_id")
def q2(spark, d):
    return table(spark, d, "events").filter("user_id % 3 = 1").select("event_id", micros(F.col("ts")).alias("t"), F.col("value").alias("util")).orderBy("t", "event_id")


@query("q4_last_progress", f"WITH {PROGRESS_SQL} SELECT id, process, config, end_num_timesteps FROM p WHERE (process, config, end_training_time_us) IN (SELECT (process, config, max(end_training_time_us)) FROM p GROUP BY process, config)")
def q4(spark, d):
    return stats.last_by(progress(spark, d), ["process", "config"], "end_training_time_us").select("id", "process", "config", "end_num_timesteps")


@query("q21_name_ids", f"{T} SELECT event_name, CAST(row_number() OVER (ORDER BY event_name) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT event_name FROM t)")
def q21(spark, d):
    return calibration.ranked(trace(spark, d), "event_name")


@query("w7_category_order", f"{T} SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT category FROM t)")
def w7(spark, d):
    return calibration.ranked(trace(spark, d), "category")


@query("q22_devices_of_machines", f"{T} SELECT machine, string_agg(DISTINCT device, '+' ORDER BY device) AS devices FROM t GROUP BY machine")
def q22(spark, d):
    return trace(spark, d).groupBy("machine").agg(F.array_join(F.array_sort(F.collect_set("device")), "+").alias("devices"))


@query(
    "a4_integrity",
    f"{T}, c AS (SELECT count(*) FILTER (WHERE category = 'Framework API C') AS framework, count(*) FILTER (WHERE category = 'Simulator C') AS simulator, count(*) FILTER (WHERE category = 'Operation' AND event_name <> 'op_0') AS ops, count(*) FILTER (WHERE category = 'Operation' AND event_name = 'op_0') AS process_ops, count(*) AS n_rows FROM t) SELECT *, 2 * (framework + simulator) + ops + process_ops = n_rows AS adds_up FROM c",
)
def a4(spark, d):
    return calibration.counts_of_kinds(trace(spark, d), F.col("event_name") == "op_0")


@query("a10_by_all_others", "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity_mean, stddev_samp(l_quantity) AS l_quantity_std FROM lineitem GROUP BY ALL")
def a10(spark, d):
    return calibration.by_all_others(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "l_quantity")


@query(
    "a12_summary_histogram",
    "WITH s AS (SELECT p_brand, CAST(round(avg(p_retailprice)) AS BIGINT) AS us, count(*) AS n FROM part GROUP BY p_brand), w AS (SELECT CAST(ceil((max(us) - min(us)) / 10) AS BIGINT) AS width FROM s), b AS (SELECT CAST(us // width AS BIGINT) AS bin, sum(us * n) AS total, sum(n) AS n FROM s, w WHERE us // width < 10 GROUP BY 1), f AS (SELECT range AS bin, CAST(coalesce(total, 0) AS BIGINT) AS total_us, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(10) LEFT JOIN b ON bin = range) SELECT bin, total_us, n, 100.0 * total_us / nullif(sum(total_us) OVER (), 0) AS percent FROM f",
)
def a12(spark, d):
    summary = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice")).cast("long").alias("us"), F.count("*").alias("n"))
    return stats.histogram(stats.repeated(summary, "n"), "us")


@query(
    "a15_split_calls",
    f"""{T}, c AS (SELECT event_name, duration_us, row_number() OVER (PARTITION BY event_name ORDER BY start_us, end_us, event_id) AS i, count(*) OVER (PARTITION BY event_name) AS total FROM t WHERE category = 'CUDA API CPU'),
k AS (SELECT *, CASE WHEN total % 2 = 0 THEN total // 2 ELSE 1 END AS kinds FROM c)
SELECT event_name, (i - 1) % kinds AS call, count(*) AS n, CAST(sum(duration_us) AS BIGINT) AS sum_us, min(duration_us) AS min_us, avg(duration_us) AS avg_us, stddev_pop(duration_us) AS std_us FROM k WHERE i > kinds GROUP BY ALL""",
)
def a15(spark, d):
    return calibration.split_by_call(trace(spark, d).filter("category = 'CUDA API CPU'"), ["event_name"], 2, discard_first=True)


@query(
    "a15_overlap_aware_sums",
    f"""{T}, m AS (SELECT *, max(end_us) OVER (PARTITION BY event_name ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM t WHERE end_us > start_us AND category = 'GPU'),
i AS (SELECT *, sum(CASE WHEN start_us <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY event_name ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM m),
r AS (SELECT event_name, max(end_us) - min(start_us) AS us FROM i GROUP BY event_name, island)
SELECT event_name, CAST(sum(us) AS BIGINT) AS busy_us FROM r GROUP BY event_name""",
)
def a15_overlap(spark, d):
    from spanweave.operators.sweep import merge_adjacent

    runs_ = merge_adjacent(trace(spark, d).filter("category = 'GPU'"), ["event_name"])
    return runs_.groupBy("event_name").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("busy_us"))


@query("a19_bar_heights", "SELECT l_returnflag AS bar, sum(m) AS us FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY bar")
def a19(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("bar"), F.col("l_linestatus").alias("part"), F.col("l_quantity").alias("us"))
    return calibration.heights(rows, ["bar"], ["part"], "us")


SHARES_SQL = f"{T}, s AS (SELECT process, sum(duration_us) FILTER (WHERE category = 'Python')::DOUBLE AS python_us, sum(duration_us) FILTER (WHERE category <> 'Python')::DOUBLE AS native_us, sum(duration_us) FILTER (WHERE category = 'GPU')::DOUBLE AS gpu_us FROM t GROUP BY process)"


@query("a24_python_shares", f"{SHARES_SQL} SELECT process, (python_us + native_us) / native_us AS speedup, 100 * python_us / (python_us + native_us) AS python_percent, 100 * gpu_us / (python_us + native_us) AS gpu_percent, 100 * python_us / native_us AS python_overhead_percent FROM s")
def a24(spark, d):
    sums = {"python_us": F.col("category") == "Python", "native_us": F.col("category") != "Python", "gpu_us": F.col("category") == "GPU"}
    times = trace(spark, d).groupBy("process").agg(*[F.sum(F.when(c, F.col("duration_us"))).alias(n) for n, c in sums.items()])
    return calibration.python_shares(times, "python_us", "native_us", "gpu_us").select("process", "speedup", "python_percent", "gpu_percent", "python_overhead_percent")


RATIO_SQL = f"""{T}, s AS (SELECT category, event_name, CAST(sum(duration_us) FILTER (WHERE process = 'p1') AS DOUBLE) AS a, CAST(sum(duration_us) FILTER (WHERE process = 'p0') AS DOUBLE) AS b FROM t GROUP BY ALL),
r AS (SELECT category, event_name, a / nullif(b, 0) AS ratio FROM s WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query("a25_ratios", f"{RATIO_SQL} SELECT * FROM r")
def a25(spark, d):
    return calibration.ratios(trace(spark, d), ["category", "event_name"], "process", "p1", "p0", "duration_us")


@query("a25_summary", f"{RATIO_SQL} SELECT category, min(ratio) AS min, max(ratio) AS max, avg(ratio) AS mean, exp(avg(ln(CASE WHEN ratio > 0 THEN ratio END))) AS geomean, stddev_samp(ratio) AS std FROM r GROUP BY category")
def a25_summary(spark, d):
    return calibration.summarized(a25(spark, d), ["category"], "ratio")


@query(
    "w4_extended_bins",
    BINS_SQL + f", v AS (SELECT process, unnest(range(min(start_us) // {PERIOD}, max(end_us) // {PERIOD} + 1)) AS bin FROM t GROUP BY process) SELECT v.process, v.bin, b.bin IS NOT NULL AS busy FROM v LEFT JOIN b ON b.process = v.process AND b.bin = v.bin",
)
def w4(spark, d):
    events = trace(spark, d)
    return calibration.extended_bins(events.filter("category = 'GPU'"), ["process"], events.groupBy("process").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")), PERIOD)


@query(
    "r11_legacy_venn",
    f"{PLAIN_SQL},{CLEAN_SQL}, sv AS (SELECT process, res, sum(time_us) AS us FROM u WHERE len(res) > 0 GROUP BY process, res), e AS (SELECT process, unnest(res) AS x, CASE WHEN len(res) = 1 THEN 1 ELSE -1 END * us AS us FROM sv), o2 AS (SELECT process, x AS region, sum(us) AS us FROM e GROUP BY process, x UNION ALL SELECT process, list_aggregate(res, 'string_agg', '+'), us FROM sv WHERE len(res) > 1) SELECT process, region, CAST(us AS BIGINT) AS time_us FROM o2 WHERE us <> 0",
)
def r11(spark, d):
    sizes = rollup.resource_overlap(keyed_regions(spark, d)).select("process", F.col("resources").alias("region"), "time_us")
    return joined(calibration.legacy_venn(sizes, ["process"]), "region")


@query("r6_self_overlap", f"{PLAIN_SQL} SELECT process, list_aggregate(list_sort(list_concat(ops, ops)), 'string_agg', '+') AS ops, CAST(sum(time_us) AS BIGINT) AS time_us FROM r GROUP BY ALL")
def r6(spark, d):
    keyed = keyed_regions(spark, d).withColumn("processes", F.array(F.lit("a"), F.lit("b")))
    return joined(rollup.self_overlap_ops(keyed), "ops").groupBy("process", "ops").agg(F.sum("time_us").alias("time_us"))


R6_SQL = f"""WITH {TRACE_SQL},{FLAT_SQL},
c AS (SELECT 'm0' AS process, process || '/op:' || event_name AS key, start_us, end_us FROM flat UNION ALL SELECT 'm0', process || '/GPU', start_us, end_us FROM t WHERE category = 'GPU' AND end_us > start_us),{SEGMENTS_SQL.format(k="c")},
l AS (SELECT e - s AS us, string_split(region, '+') AS x FROM g WHERE region LIKE '%/op:%')
SELECT list_aggregate(list_sort(list_transform(list_filter(x, lambda a: a LIKE '%/op:%'), lambda a: split_part(a, '/op:', 2))), 'string_agg', '+') AS ops,
  CASE WHEN len(list_filter(x, lambda a: a LIKE '%/GPU')) > 0 THEN 'GPU' ELSE '' END AS categories, CAST(sum(us) AS BIGINT) AS time_us FROM l GROUP BY ALL"""


@query("r6_cross_process", R6_SQL)
def r6_cross(spark, d):
    """Operations of all processes at once: one that two processes run at the same time is there twice."""
    from spanweave.operators import sweep

    lines = flatten.timeline(trace(spark, d)).filter(F.col("key").startswith("op:") | (F.col("key") == "GPU")).withColumn("key", F.concat_ws("/", "process", "key"))
    return joined(rollup.operations_over_processes(sweep.region_times(lines, ["machine"])), "ops", "categories")


@query("f3_any_category", f"{T} SELECT event_id, name FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || event_name || ']' WHEN 1 THEN '[' || event_name ELSE event_name END AS name FROM t) WHERE name NOT LIKE '[%'")
def f3_any(spark, d):
    """Names with brackets are made here, as the tables hold none; rows of any category go."""
    name = F.col("event_name")
    marked = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), name, F.lit("]"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("["), name)).otherwise(name)
    return trace(spark, d).select("event_id", marked.alias("name")).filter(~flatten.is_bracketed(F.col("name")))


@query("c16_name_map", "SELECT CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#10' THEN 'second' END AS metric, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY metric")
def c16_map(spark, d):
    """Names with the signs that mark their kind, in the other scheme; what that does not know is null."""
    marked = table(spark, d, "part").select(F.concat("p_brand", F.element_at(F.array(*map(F.lit, ["", "+", "&", "+&"])), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"))
    metric = stats.metric_names(F.col("name"), {"Brand#1": "first", "Brand#10": "second"})
    return marked.groupBy(metric.alias("metric")).agg(F.count("*").alias("n"))


@query("f7_overlap_kinds", f"{T} SELECT event_id, start_us <= 1706750000000000 AND 1706740000000000 <= end_us AS any, start_us <= 1706740000000000 AND 1706750000000000 <= end_us AS subsumes, start_us <= 1706750000000000 AND 1706740000000000 <= end_us AND NOT (start_us <= 1706740000000000 AND 1706750000000000 <= end_us) AND NOT (1706740000000000 <= start_us AND end_us <= 1706750000000000) AS partial FROM t")
def f7(spark, d):
    lo, hi = F.lit(1706740000000000), F.lit(1706750000000000)
    return trace(spark, d).select("event_id", *[P.overlap(F.col("start_us"), F.col("end_us"), lo, hi, k).alias(k) for k in ("any", "subsumes", "partial")])


@query("f10_drop_negative", f"{T} SELECT event_id FROM (SELECT event_id, start_us, end_us - 1800000000 AS end_us FROM t) WHERE end_us >= start_us")
def f10(spark, d):
    return P.negative_dropped(trace(spark, d).withColumn("end_us", F.col("end_us") - 1_800_000_000)).select("event_id")


@query("f14_steps", f"{T} SELECT process, event_name, event_id, i FROM (SELECT process, event_name, event_id, row_number() OVER (PARTITION BY process, event_name ORDER BY start_us, end_us, event_id) AS i FROM t WHERE category = 'Operation') WHERE i BETWEEN 2 AND 4")
def f14(spark, d):
    """Instances 2 to 4 of each operation: the first is left out, as it warms up."""
    from spanweave.operators.grid import grid, numbered

    by = ["process", "event_name"]
    rows = ops_of(spark, d).select(*by, "event_id", "start_us", "end_us")
    return numbered(grid(rows, by, "start_us").place(rows, bucket="start_us"), by, [F.col("start_us"), F.col("end_us"), F.col("event_id")], "i").filter("i between 2 and 4").select(*by, "event_id", "i")


@query("f15_visible_devices", f"{T} SELECT event_id, device LIKE 'cpu%' AS is_cpu FROM t WHERE device IN ('cpu0', 'gpu0')")
def f15(spark, d):
    name = F.when(F.col("device").startswith("cpu"), "Intel Xeon").otherwise("GeForce")
    return trace(spark, d).filter(F.col("device").isin("cpu0", "gpu0")).select("event_id", P.is_cpu(name).alias("is_cpu"))


@query("f20_selected", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1 AND n_name >= 'B' ORDER BY n_name")
def f20(spark, d):
    return P.selected(table(spark, d, "nation").select("n_name", "n_regionkey"), {"n_regionkey": 1, "n_name": lambda c: c >= "B"}, ["n_name"])


@query(
    "o16_interval_algebra",
    f"{T} SELECT event_id, CASE WHEN end_us < 1706740000000000 THEN 'before' WHEN start_us > 1706750000000000 THEN 'after' WHEN start_us = 1706740000000000 AND end_us = 1706750000000000 THEN 'equal' ELSE 'overlap' END AS place, least(start_us, 1706740000000000) AS merged_start, greatest(end_us, 1706750000000000) AS merged_end, CASE WHEN start_us <= 1706750000000000 AND end_us >= 1706740000000000 THEN greatest(start_us, 1706740000000000) END AS common_start FROM t",
)
def o16(spark, d):
    four = [F.col("start_us"), F.col("end_us"), F.lit(1706740000000000), F.lit(1706750000000000)]
    merged, common = P.merged_interval(*four), P.common_interval(*four)
    return trace(spark, d).select("event_id", P.order(*four).alias("place"), merged["start_us"].alias("merged_start"), merged["end_us"].alias("merged_end"), common["start_us"].alias("common_start"))


@query("fn_texts", f"{T} SELECT event_id, CASE WHEN duration_us >= 1000000 THEN printf('%.2f s', duration_us / 1e6) WHEN duration_us >= 1000 THEN printf('%.2f ms', duration_us / 1e3) WHEN duration_us >= 1 THEN printf('%.2f us', duration_us / 1.0) ELSE printf('%.2f ns', duration_us * 1000.0) END AS pretty, event_name || '(train.py)' AS name FROM t")
def fn_texts(spark, d):
    raw = F.concat("event_name", F.lit("(/home/me/train.py:17)"))
    return trace(spark, d).select("event_id", P.pretty_micros(F.col("duration_us")).alias("pretty"), P.function_name(raw).alias("name"))


@query("fn_cast", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def fn_cast(spark, d):
    texts = table(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")])
    return P.numbers_where_possible(texts, texts.columns)


STACKS_SQL = f"""{T}, sp AS (SELECT process, event_id, event_name, start_us, end_us FROM t WHERE category = 'Operation'),
st AS (
  SELECT b.process, b.event_id, string_agg(a.event_name, ';' ORDER BY a.start_us, a.end_us DESC, a.event_id) AS stack, arg_min(a.event_id, (a.start_us, -a.end_us, a.event_id)) AS root
  FROM sp a JOIN sp b ON a.process = b.process AND a.start_us <= b.start_us AND a.end_us >= b.end_us AND (a.start_us < b.start_us OR a.end_us > b.end_us OR a.event_id <= b.event_id) GROUP BY b.process, b.event_id)"""


@query("o9_stacks", f"{STACKS_SQL} SELECT process, event_id, stack, root FROM st")
def o9(spark, d):
    return flatten.stacks(ops_of(spark, d).select("process", "event_id", "event_name", "start_us", "end_us"), ["process"])


@query("k7_self_time", STACKS_SQL.replace(", sp AS", f",{FLAT_SQL}, o2 AS (SELECT process, event_id, end_us - start_us AS us FROM flat), sp AS", 1) + " SELECT process || ';' || stack AS stack, CAST(sum(us) AS BIGINT) AS us FROM st JOIN o2 USING (process, event_id) GROUP BY 1")
def k7(spark, d):
    ops = ops_of(spark, d).select("process", "event_id", "event_name", "start_us", "end_us")
    return flatten.self_times(ops, ["process"])


@query("o20_random_intervals", "SELECT range AS id, (range * 7919) % 10007 AS start_us, (range * 7919) % 10007 + 1 + (range * 104729) % 97 AS end_us FROM range(1000)")
def o20(spark, d):
    """Intervals for trials: places and lengths from multiples of primes, so that reruns agree."""
    return spark.range(1000).select("id", ((F.col("id") * 7919) % 10007).alias("start_us"), ((F.col("id") * 7919) % 10007 + 1 + (F.col("id") * 104729) % 97).alias("end_us"))

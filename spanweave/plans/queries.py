"""The operators applied to the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions import predicates as P
from spanweave.operators import flatten, overhead, rollup, stats, sweep, timeseries
from spanweave.sources.adapters import CPU_CATEGORIES, KEYS, OVERHEADS, TRACE_SQL, micros, table, trace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as one string."""
    return df.withColumns({c: F.array_join(c, "+") for c in columns})


def by_category(spark, sf_dir) -> DataFrame:
    return trace(spark, sf_dir).withColumn("key", F.col("category"))


def ops_of(spark, sf_dir) -> DataFrame:
    return trace(spark, sf_dir).filter("category = 'Operation'")


def keyed_regions(spark, sf_dir) -> DataFrame:
    """Regions of operations and categories, with overheads of a fixed calibration as categories."""
    lines = flatten.timeline(trace(spark, sf_dir))
    return rollup.category_keys(sweep.region_times(lines))


def with_overheads(spark, sf_dir) -> DataFrame:
    """The timeline with overhead intervals, in whole microseconds."""
    events = trace(spark, sf_dir)
    injected = overhead.inject(events, CALIBRATION).filter(F.col("category").isin(*OVERHEADS))
    extra = injected.select(*KEYS, "category", "event_name", F.expr("start_ps div 1000").alias("start_us"), F.expr("end_ps div 1000").alias("end_us"), F.col("category").alias("key"))
    return flatten.timeline(events).unionByName(extra)


#: Fixed values of the queries, in microseconds a call.
CALIBRATION = overhead.Calibration(cupti={"event_type_0": 60_000_000.0, "event_type_2": 30_000_000.5}, interception=45_000_000.25, annotation=20_000_000.0, framework=15_000_000.5, simulator=-3.0)

SEGMENTS_SQL = """
b AS (SELECT DISTINCT process, x AS s FROM (SELECT process, start_us AS x FROM {k} UNION ALL SELECT process, end_us FROM {k})),
s AS (SELECT process, s, lead(s) OVER (PARTITION BY process ORDER BY s) AS e FROM b),
g AS (
  SELECT s.process, s.s, s.e, coalesce(string_agg(DISTINCT k.key, '+' ORDER BY k.key), '') AS region
  FROM (SELECT * FROM s WHERE e IS NOT NULL) s LEFT JOIN {k} k ON k.process = s.process AND k.start_us < s.e AND k.end_us > s.s
  GROUP BY s.process, s.s, s.e
)"""
CATEGORY_SQL = f"WITH {TRACE_SQL}, c AS (SELECT process, category AS key, start_us, end_us FROM t WHERE end_us > start_us),{SEGMENTS_SQL.format(k='c')}"
#: Each instant's owner among the operations, then runs of one owner.
FLAT_SQL = """
o AS (SELECT process, start_us, end_us, min(event_name) AS event_name, min(event_id) AS event_id FROM t WHERE category = 'Operation' AND end_us > start_us GROUP BY process, start_us, end_us),
ob AS (SELECT DISTINCT process, x AS s FROM (SELECT process, start_us AS x FROM o UNION ALL SELECT process, end_us FROM o)),
os AS (SELECT process, s, lead(s) OVER (PARTITION BY process ORDER BY s) AS e FROM ob),
oo AS (
  SELECT os.process, os.s, os.e, arg_min(o.event_id, (o.end_us, -o.start_us, o.event_name)) AS event_id, arg_min(o.event_name, (o.end_us, -o.start_us, o.event_name)) AS event_name
  FROM os JOIN o ON o.process = os.process AND o.start_us < os.e AND o.end_us > os.s WHERE os.e IS NOT NULL GROUP BY os.process, os.s, os.e
),
oi AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS fresh FROM oo WINDOW w AS (PARTITION BY process, event_id ORDER BY s)),
oj AS (SELECT *, sum(fresh) OVER (PARTITION BY process, event_id ORDER BY s) AS piece FROM oi),
flat AS (SELECT process, event_id, event_name, min(s) AS start_us, max(e) AS end_us FROM oj GROUP BY process, event_id, event_name, piece)"""
TIMELINE_SQL = f"""WITH {TRACE_SQL},{FLAT_SQL},
c AS (
  SELECT process, 'op:' || event_name AS key, start_us, end_us FROM flat
  UNION ALL SELECT process, category, start_us, end_us FROM t WHERE category <> 'Operation' AND end_us > start_us
  {{more}}
),{SEGMENTS_SQL.format(k="c")},
q AS (
  SELECT process, sum(e - s) AS time_us, min(s) AS lo, max(e) AS hi, list_filter(string_split(region, '+'), lambda x: starts_with(x, 'op:')) AS o,
    list_filter(string_split(region, '+'), lambda x: NOT starts_with(x, 'op:')) AS c FROM g WHERE region <> '' GROUP BY process, region
),
r AS (SELECT process, time_us, lo, hi, list_transform(o, lambda x: x[4:]) AS ops, c AS non_ops FROM q WHERE len(o) > 0 AND len(c) > 0)"""
PLAIN_SQL = TIMELINE_SQL.format(more="")
CPU_SQL, OVER_SQL = f"{CPU_CATEGORIES}", f"{OVERHEADS}"
OVERHEAD_SPANS_SQL = """
  SELECT process, 'Profiling: CUPTI' AS key, start_us AS lo, start_us * 1000 + CASE event_name WHEN 'event_type_0' THEN 60000000000 WHEN 'event_type_2' THEN 30000000500 END AS hi_ps, start_us * 1000 AS lo_ps, event_name FROM t WHERE category = 'CUDA API CPU' AND event_name IN ('event_type_0', 'event_type_2')
  UNION ALL SELECT process, 'Profiling: LD_PRELOAD', end_us, end_us * 1000 + 45000000250, end_us * 1000, event_name FROM t WHERE category = 'CUDA API CPU'
  UNION ALL SELECT process, 'Profiling: Python annotation', start_us, start_us * 1000 + 20000000000, start_us * 1000, event_name FROM t WHERE category = 'Operation'
  UNION ALL SELECT process, 'Profiling: Python->C interception TensorFlow', end_us, end_us * 1000 + 2 * 15000000500, end_us * 1000 + 15000000500, event_name FROM t WHERE category = 'Framework API C'"""
OVERHEAD_SQL = TIMELINE_SQL.format(more=f"UNION ALL SELECT process, key, lo_ps // 1000, hi_ps // 1000 FROM ({OVERHEAD_SPANS_SQL}) WHERE hi_ps // 1000 > lo_ps // 1000")
#: Categories of a region without overhead, and as CPU and GPU.
CLEAN_SQL = f"""
v AS (SELECT *, CASE WHEN len(list_intersect(non_ops, {OVER_SQL})) > 0 THEN list_filter(non_ops, lambda x: NOT list_contains({CPU_SQL}, x) AND NOT list_contains({OVER_SQL}, x)) ELSE non_ops END AS clean FROM r),
u AS (SELECT *, list_sort(list_concat(CASE WHEN len(list_intersect(clean, {CPU_SQL})) > 0 THEN ['CPU'] ELSE [] END, CASE WHEN list_contains(clean, 'GPU') THEN ['GPU'] ELSE [] END)) AS res FROM v)"""
SIZES = "CAST(sum(time_us) AS BIGINT) AS time_us, min(lo) AS min_start_us, max(hi) AS max_end_us"


@query("s3_trace_adapter", f"WITH {TRACE_SQL} SELECT * FROM t")
def s3(spark, d):
    return trace(spark, d)


@query("o1_region_time", CATEGORY_SQL + " SELECT process, region, CAST(sum(e - s) AS BIGINT) AS time_us FROM g WHERE region <> '' GROUP BY process, region")
def o1(spark, d):
    return joined(sweep.region_times(by_category(spark, d)), "region").select("process", "region", "time_us")


@query("o1_region_time_keep_empty", CATEGORY_SQL + " SELECT process, region, CAST(sum(e - s) AS BIGINT) AS time_us FROM g GROUP BY process, region")
def o1_empty(spark, d):
    return joined(sweep.region_times(by_category(spark, d), keep_empty=True), "region").select("process", "region", "time_us")


@query("o2_region_bounds", CATEGORY_SQL + " SELECT process, region, min(s) AS min_start_us, max(e) AS max_end_us FROM g WHERE region <> '' GROUP BY process, region")
def o2(spark, d):
    return joined(sweep.region_times(by_category(spark, d)), "region").select("process", "region", "min_start_us", "max_end_us")


@query(
    "o3_transitions",
    CATEGORY_SQL + ", l AS (SELECT process, region, lag(region, 1, '') OVER (PARTITION BY process ORDER BY s) AS previous FROM g) SELECT process, previous, region, count(*) AS n FROM l GROUP BY process, previous, region",
)
def o3(spark, d):
    return joined(sweep.transitions(by_category(spark, d)), "region", "previous").drop("machine", "phase")


@query(
    "o4_merge_events",
    f"""WITH {TRACE_SQL}, m AS (SELECT *, max(end_us) OVER (PARTITION BY process, category ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM t WHERE end_us > start_us),
i AS (SELECT *, sum(CASE WHEN start_us <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY process, category ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT process, category, min(start_us) AS start_us, max(end_us) AS end_us FROM i GROUP BY process, category, island""",
)
def o4(spark, d):
    return sweep.merge_adjacent(trace(spark, d), ["process", "category"])


@query("o5_intervals", CATEGORY_SQL + " SELECT process, s AS start_us, e - s AS duration_us, region FROM g")
def o5(spark, d):
    return joined(sweep.segments(by_category(spark, d)), "region").select("process", "start_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "region")


@query("o6_interval_starts", CATEGORY_SQL + " SELECT g.process, g.s AS start_us, g.e AS end_us, event_id FROM g JOIN t ON t.process = g.process AND t.start_us = g.s AND t.end_us > t.start_us")
def o6(spark, d):
    events = by_category(spark, d)
    return sweep.interval_starts(events, sweep.segments(events)).drop("machine", "phase")


@query("o7_flatten_ops", f"WITH {TRACE_SQL},{FLAT_SQL} SELECT * FROM flat")
def o7(spark, d):
    return flatten.flatten_ops(ops_of(spark, d)).drop("machine", "phase")


@query("o8_flatten_one_op", f"WITH {TRACE_SQL},{FLAT_SQL} SELECT process, start_us, end_us FROM flat WHERE event_name = 'op_1'")
def o8(spark, d):
    return flatten.flatten_ops(ops_of(spark, d)).filter("event_name = 'op_1'").select("process", "start_us", "end_us")


@query(
    "o9_stack_depth",
    f"""WITH {TRACE_SQL}, o AS (SELECT * FROM t WHERE category = 'Operation')
SELECT a.process, a.event_id, count(b.event_id) AS depth, coalesce(string_agg(b.event_name, ';' ORDER BY b.start_us, b.event_id), '') AS stack
FROM o a LEFT JOIN o b ON a.process = b.process AND b.start_us <= a.start_us AND a.end_us <= b.end_us AND a.event_id <> b.event_id GROUP BY a.process, a.event_id""",
)
def o9(spark, d):
    return flatten.stack_depths(ops_of(spark, d), ["process"]).select("process", "event_id", "depth", "stack")


@query(
    "o10_bad_nesting",
    f"""WITH {TRACE_SQL}, o AS (SELECT * FROM t WHERE category = 'Operation' AND end_us > start_us)
SELECT a.process, a.event_id, b.event_id AS other_id FROM o a JOIN o b ON a.process = b.process
WHERE (a.start_us < b.start_us AND b.start_us < a.end_us AND a.end_us < b.end_us) OR (a.start_us = b.start_us AND a.end_us = b.end_us AND a.event_id < b.event_id)""",
)
def o10(spark, d):
    return flatten.bad_nesting(ops_of(spark, d)).drop("machine", "phase")


@query(
    "o13_time_splits",
    f"""WITH {TRACE_SQL}, p AS (SELECT process, min(start_us) AS lo, max(end_us) AS hi, greatest(4, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS n FROM t GROUP BY process),
q AS (SELECT *, 1 + (hi - lo) // n AS width FROM p), i AS (SELECT *, unnest(range(n)) AS split FROM q)
SELECT process, CAST(split AS BIGINT) AS split, CAST(lo + split * width AS BIGINT) AS start_us, CAST(least(hi, lo + (split + 1) * width) AS BIGINT) AS end_us FROM i""",
)
def o13(spark, d):
    period = trace(spark, d).groupBy("process").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"), F.greatest(F.lit(4), F.ceil(F.count("*") / 1000.0)).alias("n"))
    split = period.withColumn("width", F.expr("1 + (hi - lo) div n")).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return split.select("process", "split", F.expr("lo + split * width").alias("start_us"), F.expr("least(hi, lo + (split + 1) * width)").alias("end_us"))


CROSS_SQL = f"WITH {TRACE_SQL}, c AS (SELECT 'm0' AS process, process || '/' || category AS key, start_us, end_us FROM t WHERE end_us > start_us AND category IN ('GPU', 'Python')),{SEGMENTS_SQL.format(k='c')}"


def cross_process(spark, d) -> DataFrame:
    events = trace(spark, d).filter(F.col("category").isin("GPU", "Python")).withColumn("key", F.concat_ws("/", "process", "category"))
    return sweep.region_times(events, ["machine"], keep_empty=True)


@query("o17_cross_process", CROSS_SQL + " SELECT region, CAST(sum(e - s) AS BIGINT) AS time_us FROM g GROUP BY region")
def o17(spark, d):
    return joined(cross_process(spark, d), "region").select("region", "time_us")


@query("f12_overlaps_with", CATEGORY_SQL + " SELECT process, region, CAST(sum(e - s) AS BIGINT) AS time_us FROM g WHERE region LIKE '%GPU%' GROUP BY process, region")
def f12(spark, d):
    return joined(sweep.overlaps_with(sweep.region_times(by_category(spark, d)), ["GPU"]), "region").select("process", "region", "time_us")


@query(
    "o12_category_keys",
    PLAIN_SQL + " SELECT process, list_aggregate(ops, 'string_agg', '+') AS ops, list_aggregate(non_ops, 'string_agg', '+') AS non_ops, CAST(time_us AS BIGINT) AS time_us FROM r",
)
def o12(spark, d):
    return joined(keyed_regions(spark, d), "ops", "non_ops").select("process", "ops", "non_ops", "time_us")


RES = "list_aggregate(res, 'string_agg', '+')"
OUT = ["time_us", "min_start_us", "max_end_us"]


@query("r1_resource", f"{PLAIN_SQL},{CLEAN_SQL} SELECT process, {RES} AS resources, {SIZES} FROM u GROUP BY process, res")
def r1(spark, d):
    """Per process: how long only the CPU, only the GPU, or both were active inside an operation."""
    return joined(rollup.resource_overlap(keyed_regions(spark, d)), "resources").select("process", "resources", *OUT)


@query("r2_operation", f"{PLAIN_SQL},{CLEAN_SQL} SELECT process, {RES} AS resources, list_aggregate(ops, 'string_agg', '+') AS ops, {SIZES} FROM u GROUP BY process, res, ops")
def r2(spark, d):
    return joined(rollup.operation_overlap(keyed_regions(spark, d)), "resources", "ops").select("process", "resources", "ops", *OUT)


@query(
    "r3_category",
    f"{PLAIN_SQL},{CLEAN_SQL} SELECT process, list_aggregate(ops, 'string_agg', '+') AS op, {RES} AS resources, list_aggregate(clean, 'string_agg', '+') AS categories, {SIZES} FROM u GROUP BY process, ops, res, clean",
)
def r3(spark, d):
    return joined(rollup.category_overlap(keyed_regions(spark, d)), "resources", "categories").select("process", "op", "resources", "categories", *OUT)


@query("r4_subplot", f"{PLAIN_SQL},{CLEAN_SQL}, e AS (SELECT *, unnest(list_concat(['Total'], res)) AS resource FROM u) SELECT process, resource, {SIZES} FROM e GROUP BY process, resource")
def r4(spark, d):
    return rollup.resource_subplot(keyed_regions(spark, d)).select("process", "resource", *OUT)


@query(
    "r5_profiling_overhead",
    OVERHEAD_SQL
    + f""", x AS (SELECT *, list_sort(list_intersect(non_ops, {OVER_SQL})) AS over FROM r),
y AS (SELECT *, CASE WHEN list_contains(non_ops, 'GPU') OR len(over) = 0 THEN 'Corrected training time' ELSE list_aggregate(over, 'string_agg', '+') END AS overhead FROM x)
SELECT process, overhead, {SIZES} FROM y GROUP BY process, overhead""",
)
def r5(spark, d):
    keyed = rollup.category_keys(sweep.region_times(with_overheads(spark, d)))
    return joined(rollup.profiling_overhead(keyed), "overhead").select("process", "overhead", *OUT)


@query("r1_resource_corrected", f"{OVERHEAD_SQL},{CLEAN_SQL} SELECT process, {RES} AS resources, {SIZES} FROM u WHERE len(res) > 0 GROUP BY process, res")
def r1_corrected(spark, d):
    keyed = rollup.category_keys(sweep.region_times(with_overheads(spark, d)))
    return joined(rollup.resource_overlap(keyed), "resources").select("process", "resources", *OUT)


@query(
    "r7_report_period",
    f"{PLAIN_SQL},{CLEAN_SQL}, z AS (SELECT process, {RES} AS resources, {SIZES} FROM u GROUP BY process, res) SELECT process, resources, time_us, min(min_start_us) OVER w AS start_us, max(max_end_us) OVER w AS end_us FROM z WINDOW w AS (PARTITION BY process)",
)
def r7(spark, d):
    report = joined(rollup.with_period(rollup.resource_overlap(keyed_regions(spark, d))), "resources")
    return report.select("process", "resources", "time_us", "start_us", "end_us")


VENN_SQL = CATEGORY_SQL + """, z AS (SELECT process, string_split(region, '+') AS l, CAST(sum(e - s) AS BIGINT) AS n FROM g WHERE region <> '' GROUP BY process, region),
want AS (SELECT process, l FROM z UNION SELECT process, [unnest(l)] FROM z),
v AS (SELECT want.process, want.l, CAST(sum(n) AS BIGINT) AS n FROM want JOIN z ON z.process = want.process AND list_has_all(z.l, want.l) GROUP BY want.process, want.l)"""


def inclusive(spark, d) -> DataFrame:
    return rollup.venn_inclusive(sweep.region_times(by_category(spark, d)), ["process"])


@query("r8_venn_inclusive", VENN_SQL + " SELECT process, list_aggregate(l, 'string_agg', '+') AS region, n AS time_us FROM v")
def r8(spark, d):
    return joined(inclusive(spark, d), "region")


@query("r9_venn_exclusive", VENN_SQL + " SELECT process, list_aggregate(l, 'string_agg', '+') AS region, n AS time_us FROM z")
def r9(spark, d):
    return joined(rollup.venn_exclusive(inclusive(spark, d), ["process"], most=5), "region")


@query(
    "r10_stacked_sizes",
    VENN_SQL + " SELECT a.process, list_aggregate(a.l, 'string_agg', '+') AS region, CAST(any_value(a.n) - coalesce(sum(b.n), 0) AS BIGINT) AS time_us FROM v a LEFT JOIN v b ON a.process = b.process AND len(b.l) > len(a.l) AND list_has_all(b.l, a.l) GROUP BY a.process, a.l",
)
def r10(spark, d):
    return joined(rollup.stacked_sizes(inclusive(spark, d), ["process"]), "region")


@query("r12_total", CATEGORY_SQL + " SELECT process, CAST(sum(e - s) AS BIGINT) AS time_us FROM g WHERE region <> '' GROUP BY process")
def r12(spark, d):
    return rollup.total_size(sweep.region_times(by_category(spark, d)), ["process"])


@query(
    "r13_subplot_from_overlap",
    f"""{PLAIN_SQL},{CLEAN_SQL}, z AS (SELECT process, res, sum(time_us) AS n FROM u GROUP BY process, res),
w AS (SELECT DISTINCT process, res FROM z UNION SELECT process, [unnest(res)] FROM z),
i AS (SELECT w.process, w.res, sum(n) AS n FROM w JOIN z ON z.process = w.process AND list_has_all(z.res, w.res) GROUP BY w.process, w.res)
SELECT process, res[1] AS resource, CAST(n AS BIGINT) AS time_us FROM i WHERE len(res) = 1
UNION ALL SELECT process, 'Total', CAST(sum(CASE WHEN len(res) = 1 THEN n ELSE -n END) AS BIGINT) FROM i GROUP BY process""",
)
def r13(spark, d):
    overlap = rollup.venn_inclusive(rollup.resource_overlap(keyed_regions(spark, d)), ["process"], "resources")
    return rollup.subplot_from_overlap(overlap, ["process"])


# Metadata queries.
LO, HI = 1_704_500_000_000_000, 1_705_500_000_000_000
EVENT_OUT = ["event_id", "process", "category", "event_name", "start_us", "end_us"]
EVENTS = f"WITH {TRACE_SQL} SELECT " + ", ".join(EVENT_OUT) + " FROM t "


@query("q1_devices_with_samples", "SELECT DISTINCT 'gpu' || (user_id % 2) AS device FROM events WHERE value IS NOT NULL")
def q1(spark, d):
    samples = table(spark, d, "events").filter("value is not null").select(F.concat(F.lit("gpu"), F.col("user_id") % 2).alias("device"))
    devices = spark.range(4).select(F.concat(F.lit("gpu"), F.col("id")).alias("device"))
    return devices.join(samples, "device", "left_semi")


@query("q3_trace_start", f"WITH {TRACE_SQL} SELECT min(x) AS start_us FROM (SELECT min(start_us) AS x FROM t UNION SELECT min(epoch_us(o_orderdate)) FROM orders)")
def q3(spark, d):
    orders = table(spark, d, "orders").agg(F.min(micros(F.col("o_orderdate"))).alias("x"))
    return trace(spark, d).agg(F.min("start_us").alias("x")).union(orders).agg(F.min("x").alias("start_us"))


@query("q5_phases", f"WITH {TRACE_SQL} SELECT machine, process, phase, min(start_us) AS start_us, max(end_us) AS end_us FROM t GROUP BY machine, process, phase")
def q5(spark, d):
    return trace(spark, d).groupBy(*KEYS).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


@query("q6_operations", f"WITH {TRACE_SQL} SELECT DISTINCT machine, process, phase, event_name FROM t WHERE category = 'Operation'")
def q6(spark, d):
    return ops_of(spark, d).select(*KEYS, "event_name").distinct()


@query("q7_op_names", f"WITH {TRACE_SQL} SELECT DISTINCT event_name FROM t WHERE category = 'Operation' AND NOT regexp_matches(event_name, '^\\[.*\\]$')")
def q7(spark, d):
    return ops_of(spark, d).filter(~F.col("event_name").rlike(flatten.PROCESS_OP)).select("event_name").distinct().orderBy("event_name")


@query("q8_categories", f"WITH {TRACE_SQL} SELECT DISTINCT machine, process, category FROM t")
def q8(spark, d):
    return trace(spark, d).select("machine", "process", "category").distinct()


@query("q9_steps", f"WITH {TRACE_SQL} SELECT process, event_name, event_id, row_number() OVER (PARTITION BY process, event_name ORDER BY start_us, event_id) - 1 AS step FROM t WHERE category = 'Operation'")
def q9(spark, d):
    w = Window.partitionBy("process", "event_name").orderBy("start_us", "event_id")
    return ops_of(spark, d).select("process", "event_name", "event_id", (F.row_number().over(w) - 1).cast("long").alias("step"))


@query("q10_op_instances", f"WITH {TRACE_SQL} SELECT a.process, a.event_id AS op_id, b.event_id FROM t a JOIN t b ON a.process = b.process AND a.start_us <= b.end_us AND b.start_us <= a.end_us WHERE a.category = 'Operation' AND b.category <> 'Operation'")
def q10(spark, d):
    events = trace(spark, d)
    return flatten.instances_with_events(ops_of(spark, d), events.filter("category <> 'Operation'")).drop("machine", "phase")


@query("q11_timeline", f"WITH {TRACE_SQL},{FLAT_SQL} SELECT process, 'Operation' AS category, event_name, start_us, end_us FROM flat UNION ALL SELECT process, category, event_name, start_us, end_us FROM t WHERE category <> 'Operation'")
def q11(spark, d):
    return flatten.timeline(trace(spark, d)).select("process", "category", "event_name", "start_us", "end_us")


@query("q12_trace_sec", f"WITH {TRACE_SQL} SELECT (max(end_us) - min(start_us)) / 1e6 AS trace_sec FROM t")
def q12(spark, d):
    return trace(spark, d).agg(((F.max("end_us") - F.min("start_us")) / 1e6).alias("trace_sec"))


@query("q13_trace_period", f"WITH {TRACE_SQL} SELECT process, min(start_us) - 1 AS start_us, max(end_us) + 1 AS end_us, count(*) AS n FROM t GROUP BY process")
def q13(spark, d):
    real = trace(spark, d).filter(~flatten.is_process_op(F.col("category"), F.col("event_name")))
    return real.groupBy("process").agg((F.min("start_us") - 1).alias("start_us"), (F.max("end_us") + 1).alias("end_us"), F.count("*").alias("n"))


@query("q14_split_events", EVENTS + f"WHERE start_us <= {HI} AND end_us >= {LO} AND process = 'p1'")
def q14(spark, d):
    return trace(spark, d).filter(P.identity(process="p1") & P.in_split(LO, HI)).select(*EVENT_OUT)


@query("q15_events_in_op", EVENTS + "WHERE category <> 'Operation' AND EXISTS (SELECT 1 FROM t o WHERE o.category = 'Operation' AND o.event_name = 'op_1' AND o.process = t.process AND o.start_us <= t.start_us AND t.end_us <= o.end_us)")
def q15(spark, d):
    events = trace(spark, d)
    ops = ops_of(spark, d).filter("event_name = 'op_1'")
    return flatten.held_events(ops, events.filter("category <> 'Operation'"), ["process"]).select(*EVENT_OUT)


@query("q16_event_by_id", EVENTS + "WHERE event_id = 17")
def q16(spark, d):
    return trace(spark, d).filter("event_id = 17").select(*EVENT_OUT)


@query("q17_time_range", EVENTS + f"WHERE start_us BETWEEN {LO} AND {HI} OR end_us BETWEEN {LO} AND {HI}")
def q17(spark, d):
    return trace(spark, d).filter(P.touches_end(LO, HI)).select(*EVENT_OUT)


@query("q19_by_category", EVENTS + "WHERE category IN ('Framework API C', 'CUDA API CPU')")
def q19(spark, d):
    return trace(spark, d).filter(P.categories(keep=["Framework API C", "CUDA API CPU"])).select(*EVENT_OUT)


@query("q20_without_profiling", EVENTS + "WHERE NOT starts_with(category, 'Profiling: ')")
def q20(spark, d):
    return trace(spark, d).filter(P.categories(ignore=OVERHEADS)).select(*EVENT_OUT)


@query("f6_split_membership", f"WITH {TRACE_SQL} SELECT process, event_id, greatest(start_us, {LO}) AS start_us, least(end_us, {HI}) AS end_us FROM t WHERE start_us <= {HI} AND end_us >= {LO}")
def f6(spark, d):
    return trace(spark, d).filter(P.in_split(LO, HI)).select("process", "event_id", *P.clipped(LO, HI))


@query("f5_contained", EVENTS + f"WHERE start_us >= {LO} AND end_us <= {HI}")
def f5(spark, d):
    return trace(spark, d).filter(P.contained(LO, HI)).select(*EVENT_OUT)


@query("f10_clamped", f"WITH {TRACE_SQL} SELECT event_id, greatest(start_us, end_us - 1800000000) AS end_us FROM t")
def f10(spark, d):
    shifted = trace(spark, d).withColumn("end_us", F.col("end_us") - 1_800_000_000)
    return P.negative_clamped(shifted).select("event_id", "end_us")


@query("f16_iqr", f"WITH {TRACE_SQL}, q AS (SELECT quantile_cont(duration_us, 0.25) AS a, quantile_cont(duration_us, 0.75) AS b FROM t) SELECT event_id, duration_us FROM t, q WHERE duration_us BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def f16(spark, d):
    return stats.without_outliers(trace(spark, d).select("event_id", "duration_us"), "duration_us")


@query("f18_seconds", f"WITH {TRACE_SQL} SELECT event_id, start_us / 1e6 AS start_sec, end_us / 1e6 AS end_sec FROM t")
def f18(spark, d):
    return P.to_seconds(trace(spark, d).select("event_id", "start_us", "end_us"))


# Aggregations.
API_SQL = "SELECT l_suppkey AS tid, l_returnflag || l_linestatus AS api_name, CAST(sum(round(l_extendedprice)) AS BIGINT) AS total_time_us, count(*) AS num_calls FROM lineitem GROUP BY ALL"


def api_stats(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tid"), F.concat("l_returnflag", "l_linestatus").alias("api_name"), F.round("l_extendedprice").cast("long").alias("us"))
    return rows.groupBy("tid", "api_name").agg(F.sum("us").alias("total_time_us"), F.count("*").alias("num_calls"))


@query("a1_api_stats", f"WITH a AS ({API_SQL}) SELECT api_name, CAST(sum(total_time_us) AS BIGINT) AS total_time_us, CAST(sum(num_calls) AS BIGINT) AS num_calls, sum(total_time_us) / sum(num_calls) AS us_per_call FROM a GROUP BY api_name")
def a1(spark, d):
    sums = api_stats(spark, d).groupBy("api_name").agg(F.sum("total_time_us").alias("total_time_us"), F.sum("num_calls").alias("num_calls"))
    return sums.withColumn("us_per_call", F.col("total_time_us") / F.col("num_calls"))


@query("a3_event_counts", f"WITH {TRACE_SQL} SELECT process, count(*) FILTER (WHERE category IN ('Framework API C', 'Simulator C')) AS n_intercepted, count(*) FILTER (WHERE category = 'Operation') AS n_ops, count(*) AS n FROM t GROUP BY process")
def a3(spark, d):
    return trace(spark, d).groupBy("process").agg(
        F.count_if(F.col("category").isin("Framework API C", "Simulator C")).alias("n_intercepted"), F.count_if(F.col("category") == "Operation").alias("n_ops"), F.count("*").alias("n")
    )


PROGRESS_SQL = """p AS (
  SELECT c_mktsegment AS process, epoch_us(o_orderdate) AS t, sum(count(*)) OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate) AS steps
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderdate)"""


def progress(spark, d) -> DataFrame:
    """Cumulative order counts of each customer segment, as training progress."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("process"))
    daily = table(spark, d, "orders").join(customers, "o_custkey").groupBy("process", micros(F.col("o_orderdate")).alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("process").orderBy("t")  # a row for each date at most
    return daily.withColumn("steps", F.sum("n").over(w)).select("process", "t", "steps")


@query("a6_last_progress", f"WITH {PROGRESS_SQL} SELECT process, t, CAST(steps AS BIGINT) AS steps FROM p QUALIFY t = max(t) OVER (PARTITION BY process)")
def a6(spark, d):
    return stats.last_by(progress(spark, d), ["process"], "t")


@query("a8_extrapolate", f"WITH {PROGRESS_SQL} SELECT process, (max(t) - min(t)) / 1e6 AS train_sec, (max(t) - min(t)) / 1e6 / (max(steps) / 100000.0) AS total_sec, max(steps) / ((max(t) - min(t)) / 1e6) AS steps_per_sec FROM p GROUP BY process")
def a8(spark, d):
    ends = progress(spark, d).groupBy("process").agg(((F.max("t") - F.min("t")) / 1e6).alias("train_sec"), F.max("steps").alias("steps"))
    return ends.select("process", "train_sec", (F.col("train_sec") / (F.col("steps") / 100000.0)).alias("total_sec"), (F.col("steps") / F.col("train_sec")).alias("steps_per_sec"))


@query(
    "a9_agg_stats",
    f"WITH {TRACE_SQL} SELECT category, min(duration_us) AS duration_us_min, max(duration_us) AS duration_us_max, avg(duration_us) AS duration_us_mean, stddev_samp(duration_us) AS duration_us_std FROM t GROUP BY category",
)
def a9(spark, d):
    return stats.flattened(trace(spark, d), ["category"], ["duration_us"])


@query(
    "a11_histogram",
    f"""WITH {TRACE_SQL}, w AS (SELECT CAST(ceil((max(duration_us) - min(duration_us)) / 10.0) AS BIGINT) AS width FROM t),
h AS (SELECT duration_us // width AS bin, sum(duration_us) AS total_us, count(*) AS n FROM t, w WHERE duration_us // width < 10 GROUP BY bin),
f AS (SELECT b.bin, coalesce(total_us, 0) AS total_us, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN h ON h.bin = b.bin)
SELECT bin, CAST(total_us AS BIGINT) AS total_us, n, 100.0 * total_us / sum(total_us) OVER () AS percent FROM f""",
)
def a11(spark, d):
    return stats.histogram(trace(spark, d).select("duration_us"), "duration_us")


@query(
    "a13_kernels_running",
    CROSS_SQL + ", n AS (SELECT len(list_filter(string_split(region, '+'), lambda x: x LIKE '%/GPU')) AS n_running, sum(e - s) AS us FROM g GROUP BY n_running) SELECT CAST(n_running AS INTEGER) AS n_running, CAST(us AS BIGINT) AS time_us, 100.0 * us / sum(us) OVER () AS percent FROM n",
)
def a13(spark, d):
    running = F.size(F.filter("region", lambda x: x.endswith("/GPU")))
    times = cross_process(spark, d).groupBy(running.alias("n_running")).agg(F.sum("time_us").alias("time_us"))
    return stats.percent_within(times.withColumn("one", F.lit(1)), ["one"], "time_us").drop("one")


@query("a15_call_stats", f"WITH {TRACE_SQL} SELECT event_name, CAST(sum(duration_us) AS BIGINT) AS sum, min(duration_us) AS min, avg(duration_us) AS avg, stddev_pop(duration_us) AS std, count(*) AS n FROM t GROUP BY event_name")
def a15(spark, d):
    return stats.call_stats(trace(spark, d), ["event_name"], "duration_us")


@query("a16_nullsum", f"WITH {TRACE_SQL}, n AS (SELECT process, event_name, nullif(duration_us // 60000000, 5) AS x FROM t) SELECT process, event_name, CASE WHEN count(*) = count(x) THEN CAST(sum(x) AS BIGINT) END AS x FROM n GROUP BY process, event_name")
def a16(spark, d):
    minutes = trace(spark, d).select("process", "event_name", F.expr("nullif(duration_us div 60000000, 5)").alias("x"))
    return minutes.groupBy("process", "event_name").agg(stats.poisoned_sum(F.col("x")).alias("x"))


@query("a17_percent", f"WITH {TRACE_SQL}, s AS (SELECT process, category, CAST(sum(duration_us) AS BIGINT) AS us FROM t GROUP BY process, category) SELECT *, 100.0 * us / sum(us) OVER (PARTITION BY process) AS percent FROM s")
def a17(spark, d):
    return stats.percent_within(trace(spark, d).groupBy("process", "category").agg(F.sum("duration_us").alias("us")), ["process"], "us")


@query("a18_mean_reps", f"WITH {TRACE_SQL}, s AS (SELECT category, event_name, process, sum(duration_us) AS s FROM t GROUP BY ALL) SELECT category, event_name, avg(s) AS duration_us FROM s GROUP BY category, event_name")
def a18(spark, d):
    return stats.mean_of_repetitions(trace(spark, d), ["category", "event_name"], "process", "duration_us")


@query(
    "a20_transition_by_category",
    f"""{PLAIN_SQL}, l AS (SELECT process, string_split(region, '+') AS b, string_split(lag(region, 1, '') OVER (PARTITION BY process ORDER BY s), '+') AS a FROM g),
m AS (SELECT list_filter(b, lambda x: starts_with(x, 'op:')) AS ob, list_filter(a, lambda x: starts_with(x, 'op:')) AS oa, list_filter(b, lambda x: x <> '' AND NOT starts_with(x, 'op:') AND NOT list_contains(a, x)) AS new FROM l),
x AS (SELECT ob[1] AS op, unnest(new) AS category FROM m WHERE len(oa) = 1 AND oa = ob)
SELECT op, category, count(*) AS n FROM x GROUP BY op, category""",
)
def a20(spark, d):
    return stats.transition_categories(sweep.transitions(flatten.timeline(trace(spark, d))))


@query(
    "a21_overhead_counts",
    f"""WITH {TRACE_SQL}, k AS (SELECT process, CASE category WHEN 'CUDA API CPU' THEN 'api' WHEN 'Operation' THEN 'annotation' WHEN 'Framework API C' THEN 'interception' WHEN 'Simulator C' THEN 'interception' END AS kind, event_name FROM t)
SELECT process, kind, event_name, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL""",
)
def a21(spark, d):
    return overhead.call_counts(trace(spark, d)).drop("machine", "phase")


# Time series.
@query("w1_delay", f"WITH {TRACE_SQL} SELECT * FROM (SELECT process, category, event_id, lead(start_us) OVER w - end_us AS delay_us FROM t WINDOW w AS (PARTITION BY process, category ORDER BY start_us, end_us, event_id)) WHERE delay_us IS NOT NULL")
def w1(spark, d):
    return timeseries.delays(trace(spark, d), ["process", "category"])


@query(
    "w1_delay_stats",
    f"""WITH {TRACE_SQL}, x AS (SELECT process, category, lead(start_us) OVER w - end_us AS d FROM t WINDOW w AS (PARTITION BY process, category ORDER BY start_us, end_us, event_id))
SELECT process, category, CASE WHEN d >= 0 THEN 'delay' ELSE 'overlapped' END AS kind, avg(d) AS mean_us, stddev_pop(d) AS std_us, count(*) AS n FROM x WHERE d IS NOT NULL GROUP BY ALL""",
)
def w1_stats(spark, d):
    by = ["process", "category"]
    return timeseries.delay_stats(timeseries.delays(trace(spark, d), by), by)


EMA_SQL = f"""WITH RECURSIVE {TRACE_SQL},
s AS MATERIALIZED (SELECT process, start_us AS t, duration_us / 3e10 AS x, row_number() OVER (PARTITION BY process ORDER BY start_us, duration_us) AS i FROM t),
m AS (SELECT process, i, t, CAST(0.99 * x AS DOUBLE) AS ema FROM s WHERE i = 1 UNION ALL SELECT s.process, s.i, s.t, CAST(0.99 * s.x + (1 - 0.99::DOUBLE) * m.ema AS DOUBLE) FROM m JOIN s ON s.process = m.process AND s.i = m.i + 1),
b AS (SELECT process, t, ema, min(t) OVER (PARTITION BY process) AS t0, lead(t) OVER (PARTITION BY process ORDER BY i) AS next_t FROM m)
SELECT process, t0 + k * 3600000000 AS t, ema FROM (SELECT *, unnest(range(greatest(1, (t - t0 + 3599999999) // 3600000000), (next_t - t0 + 3599999999) // 3600000000)) AS k FROM b WHERE next_t IS NOT NULL)"""


@query("w2_ema", EMA_SQL)
def w2(spark, d):
    samples = trace(spark, d).select("process", F.col("start_us").alias("t"), (F.col("duration_us") / 3e10).alias("x"))
    return timeseries.moving_average(samples, ["process"], 3_600_000_000)


PERIOD = 600_000_000
BINS_SQL = f"WITH {TRACE_SQL}, b AS (SELECT DISTINCT process, unnest(range(start_us // {PERIOD}, end_us // {PERIOD} + 1)) AS bin FROM t WHERE category = 'GPU')"


@query("w3_poll_bins", BINS_SQL + " SELECT process, bin FROM b")
def w3(spark, d):
    return timeseries.busy_bins(trace(spark, d).filter("category = 'GPU'"), ["process"], PERIOD)


@query("w5_sliding_util", BINS_SQL + " SELECT process, bin, count(*) OVER (PARTITION BY process ORDER BY bin RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) / 12.0 AS util FROM b")
def w5(spark, d):
    return timeseries.sliding_utilization(trace(spark, d).filter("category = 'GPU'"), ["process"], PERIOD, 12)


@query("w6_trace_percent", f"WITH {TRACE_SQL} SELECT process, event_id, (start_us - min(start_us) OVER w)::DOUBLE / (max(start_us) OVER w - min(start_us) OVER w) AS trace_percent FROM t WINDOW w AS (PARTITION BY process)")
def w6(spark, d):
    return timeseries.trace_percent(trace(spark, d).select("process", "event_id", "start_us"), ["process"], "start_us").drop("start_us")


@query(
    "s10_device_id",
    "SELECT event_id, 'gpu' AS device_name, CAST(row_number() OVER w - 1 AS INTEGER) AS device_id, printf('gpu.%02d', row_number() OVER w - 1) AS device FROM events WINDOW w AS (PARTITION BY date_trunc('hour', ts) ORDER BY event_id)",
)
def s10(spark, d):
    samples = table(spark, d, "events").select("event_id", F.lit("gpu").alias("device_name"), F.date_trunc("hour", F.col("ts")).alias("hour"))
    return timeseries.device_ids(samples, ["device_name"], "hour", "event_id").drop("hour")


LANES_SQL = f"""WITH RECURSIVE {TRACE_SQL},
s AS MATERIALIZED (SELECT process, category, event_id, event_name, start_us, end_us, row_number() OVER (PARTITION BY process, category ORDER BY start_us, end_us, event_id) AS i FROM t),
m AS (
  SELECT process, category, i, CAST(0 AS BIGINT) AS lane, [end_us] AS ends FROM s WHERE i = 1
  UNION ALL SELECT process, category, i, lane, CASE WHEN lane < len(ends) THEN list_transform(ends, lambda e, j: CASE WHEN j = lane + 1 THEN end_us ELSE e END) ELSE list_append(ends, end_us) END
  FROM (
    SELECT s.process, s.category, s.i, s.end_us, m.ends, CAST(CASE WHEN list_min(m.ends) <= s.start_us THEN list_position(m.ends, list_max(list_filter(m.ends, lambda e: e <= s.start_us))) - 1 ELSE len(m.ends) END AS BIGINT) AS lane
    FROM m JOIN s ON s.process = m.process AND s.category = m.category AND s.i = m.i + 1))"""


@query("o14_lanes", LANES_SQL + " SELECT process, category, event_id, start_us, end_us, lane FROM m JOIN s USING (process, category, i)")
def o14(spark, d):
    return timeseries.lanes(trace(spark, d), ["process", "category"])


# Calibration and derived reports.
RUNS_SQL = """u AS (SELECT l_returnflag AS api, l_orderkey % 8 AS rep, CAST(sum(round(l_extendedprice)) AS BIGINT) AS us, count(*) AS calls FROM lineitem WHERE l_linestatus = '{0}' GROUP BY ALL)"""


def runs(spark, d, status: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(F.col("l_linestatus") == status)
    return rows.groupBy(F.col("l_returnflag").alias("api"), (F.col("l_orderkey") % 8).alias("rep")).agg(F.sum(F.round("l_extendedprice").cast("long")).alias("us"), F.count("*").alias("calls"))


PAIR_SQL = """WITH a AS (SELECT {g} l_orderkey % 8 AS rep, sum(round(l_extendedprice)) AS us, count(*) AS calls FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
b AS (SELECT {g} l_orderkey % 8 AS rep, sum(round(l_extendedprice)) AS us, count(*) AS calls FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
x AS (SELECT *, row_number() OVER ({p} ORDER BY rep) AS i FROM a), y AS (SELECT *, row_number() OVER ({p} ORDER BY rep) AS i FROM b)"""


def per_repetition(df: DataFrame) -> DataFrame:
    return df.groupBy("rep").agg(F.sum("us").alias("us"), F.sum("calls").alias("calls"))


@query("c1_interception", PAIR_SQL.format(g="", p="") + " SELECT avg((x.us - y.us) / x.calls) AS mean_us, stddev_pop((x.us - y.us) / x.calls) AS std_us, count(*) AS n FROM x JOIN y USING (i)")
def c1(spark, d):
    both = [per_repetition(runs(spark, d, s)).withColumn("all", F.lit(0)) for s in ("O", "F")]
    pairs = stats.row_by_row(*both, ["all"], "rep", ("_int", "_unins"))
    return stats.overhead_per_call(pairs, ["all"], "us_int", "us_unins", "calls_int").drop("all")


@query("c2_cupti", PAIR_SQL.format(g="l_returnflag AS api,", p="PARTITION BY api") + " SELECT x.api, avg(x.us / x.calls - y.us / y.calls) AS mean_us, stddev_pop(x.us / x.calls - y.us / y.calls) AS std_us, count(*) AS n FROM x JOIN y USING (api, i) GROUP BY x.api")
def c2(spark, d):
    pairs = stats.row_by_row(runs(spark, d, "O"), runs(spark, d, "F"), ["api"], "rep", ("_on", "_off"))
    each = pairs.select("api", (F.col("us_on") / F.col("calls_on")).alias("a"), (F.col("us_off") / F.col("calls_off")).alias("b"), F.lit(1).alias("one"))
    return stats.overhead_per_call(each, ["api"], "a", "b", "one")


COST_SQL = "WITH a AS (SELECT l_suppkey % 5 AS run, l_returnflag AS api_name, count(*) AS n, CAST(sum(round(l_extendedprice)) AS BIGINT) AS us FROM lineitem GROUP BY ALL), p(api_name, mean_us) AS (VALUES ('A', 12.5), ('R', 3.25)), t AS (SELECT run, CAST(sum(us) AS BIGINT) AS total_us FROM a GROUP BY run), o AS (SELECT run, sum(n * mean_us) AS overhead_us FROM a JOIN p USING (api_name) GROUP BY run)"


def costs(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("run"), F.col("l_returnflag").alias("api_name")).agg(F.count("*").alias("n"), F.sum(F.round("l_extendedprice").cast("long")).alias("us"))
    per_call = spark.createDataFrame([("A", 12.5), ("R", 3.25)], "api_name string, mean_us double")
    return overhead.corrected_time(rows.groupBy("run").agg(F.sum("us").alias("total_us")), rows, per_call, ["run"])


@query("c6_corrected", COST_SQL + " SELECT run, total_us, CAST(coalesce(overhead_us, 0) AS DOUBLE) AS overhead_us, CAST(total_us - coalesce(overhead_us, 0) AS DOUBLE) AS corrected_us FROM t LEFT JOIN o USING (run)")
def c6(spark, d):
    return costs(spark, d)


@query("c7_melt", COST_SQL + " SELECT run, 'overhead_us' AS overhead_type, CAST(coalesce(overhead_us, 0) AS DOUBLE) AS overhead_us FROM t LEFT JOIN o USING (run) UNION ALL SELECT run, 'corrected_us', CAST(total_us - coalesce(overhead_us, 0) AS DOUBLE) FROM t LEFT JOIN o USING (run)")
def c7(spark, d):
    return overhead.melted(costs(spark, d).drop("total_us"), ["run"])


@query("c8_bias", "SELECT l_returnflag AS algo, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS corrected_us, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS uninstrumented_us, 100 * (avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') - avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F')) / avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS bias_percent FROM lineitem GROUP BY algo")
def c8(spark, d):
    kind = F.when(F.col("l_linestatus") == "O", "corrected").otherwise("uninstrumented")
    return overhead.bias(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("algo"), kind.alias("kind"), F.col("l_extendedprice").alias("time_us")), ["algo"])


@query(
    "c9_overhead_percent",
    f"WITH {RUNS_SQL.format('O')}, v AS (SELECT l_returnflag AS api, l_orderkey % 8 AS rep, sum(round(l_extendedprice)) AS us FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) SELECT u.api, u.rep, 100.0 * (u.us - v.us) / v.us AS overhead_percent FROM u LEFT JOIN v ON u.api = v.api AND u.rep = v.rep",
)
def c9(spark, d):
    plain = P.with_suffix(runs(spark, d, "F"), "_unins", ["us", "calls"])
    both = runs(spark, d, "O").join(plain, ["api", "rep"], "left")
    return both.select("api", "rep", F.try_divide(100.0 * (F.col("us") - F.col("us_unins")), F.col("us_unins").cast("double")).alias("overhead_percent"))


@query(
    "c11_breakdown",
    f"{PLAIN_SQL},{CLEAN_SQL}, z AS (SELECT process, list_aggregate(ops, 'string_agg', '+') AS op, {RES} AS resources, sum(time_us) AS us FROM u GROUP BY process, ops, res) SELECT process, op, resources, 100.0 * us / sum(us) OVER (PARTITION BY process) AS percent, us / sum(us) OVER (PARTITION BY process) * 3600.0 AS uninstrumented_sec FROM z",
)
def c11(spark, d):
    shares = stats.percent_within(joined(rollup.operation_overlap(keyed_regions(spark, d)), "ops", "resources"), ["process"], "time_us")
    return shares.select("process", F.col("ops").alias("op"), "resources", "percent", (F.col("percent") / 100 * 3600.0).alias("uninstrumented_sec"))


HW_SQL = "r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' ELSE 'a/b/c' END AS range_name, sum(l_quantity) AS value, sum(l_tax) AS percent FROM lineitem GROUP BY ALL)"


@query("c14_gpu_hw", f"WITH {HW_SQL} SELECT x.range_name, any_value(x.value) AS value, sum(y.percent) AS percent, any_value(x.value) * sum(y.percent) AS total FROM r x JOIN r y ON y.range_name = x.range_name OR starts_with(y.range_name, x.range_name || '/') GROUP BY x.range_name")
def c14(spark, d):
    names = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "a/b").otherwise("a/b/c")
    rows = table(spark, d, "lineitem").groupBy(names.alias("range_name")).agg(F.sum("l_quantity").alias("value"), F.sum("l_tax").alias("percent"))
    return stats.reattributed(rows.select("range_name", "value"), rows.select("range_name", "percent"))


@query("c15_inject", f"WITH {TRACE_SQL} SELECT process, key AS category, event_name, lo_ps AS start_ps, hi_ps AS end_ps FROM ({OVERHEAD_SPANS_SQL}) UNION ALL SELECT process, category, event_name, start_us * 1000, end_us * 1000 FROM t")
def c15(spark, d):
    return overhead.inject(trace(spark, d), CALIBRATION).drop("machine", "phase")


@query("k7_folded_stacks", f"WITH {TRACE_SQL} SELECT process || ';' || category || ';' || event_name AS stack, CAST(sum(duration_us) AS BIGINT) AS us FROM t GROUP BY stack")
def k7(spark, d):
    return trace(spark, d).groupBy(F.concat_ws(";", "process", "category", "event_name").alias("stack")).agg(F.sum("duration_us").alias("us"))


from spanweave.plans import derived, scans  # noqa: E402, F401 (they register their queries)

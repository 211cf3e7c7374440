"""Reports from regions: resources, operations, categories, profiling overhead, and Venn sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.plans.lineage import cut_lineage
from spanweave.sources.adapters import CPU_CATEGORIES, GPU, KEYS, OVERHEADS


def _only(a: Column, names: list[str]) -> Column:
    return F.array_intersect(a, F.array(*map(F.lit, names)))


def category_keys(regions: DataFrame) -> DataFrame:
    """Splits ``region`` (op:… and categories) into ``ops`` and ``non_ops``; only regions with both are in a report."""
    ops = F.transform(F.filter("region", lambda x: x.startswith("op:")), lambda x: F.substr(x, F.lit(4)))
    rest = F.filter("region", lambda x: ~x.startswith("op:"))
    return regions.withColumns({"ops": F.array_sort(ops), "non_ops": F.array_sort(rest)}).filter((F.size("ops") > 0) & (F.size("non_ops") > 0))


def without_overhead(non_ops: Column) -> Column:
    """With any profiling overhead active, the CPU's categories and the overhead go."""
    hidden = F.array(*map(F.lit, [*CPU_CATEGORIES, *OVERHEADS]))
    return F.when(F.arrays_overlap(non_ops, F.array(*map(F.lit, OVERHEADS))), F.array_except(non_ops, hidden)).otherwise(non_ops)


def cpu_gpu(non_ops: Column) -> Column:
    """Categories as CPU and GPU; overheads stay as they are."""
    cpu = F.when(F.size(_only(non_ops, CPU_CATEGORIES)) > 0, F.array(F.lit("CPU"))).otherwise(F.array().cast("array<string>"))
    gpu = F.when(F.array_contains(non_ops, GPU), F.array(F.lit("GPU"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.concat(cpu, gpu, _only(non_ops, OVERHEADS)))


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("time_us").alias("time_us"), F.min("min_start_us").alias("min_start_us"), F.max("max_end_us").alias("max_end_us"))


def resource_overlap(keyed: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Time with only the CPU, only the GPU, or both active: ``by, resources, time_us, …``."""
    return _sums(keyed.withColumn("resources", cpu_gpu(without_overhead(F.col("non_ops")))).filter(F.size("resources") > 0), *by, "resources")


def operation_overlap(keyed: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """The same for each set of operations."""
    return _sums(keyed.withColumn("resources", cpu_gpu(without_overhead(F.col("non_ops")))).filter(F.size("resources") > 0), *by, "resources", "ops")


def category_overlap(keyed: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Time of each set of categories, for each operation and resource set."""
    clean = keyed.withColumn("categories", without_overhead(F.col("non_ops"))).filter(F.size("categories") > 0)
    return _sums(clean.withColumns({"op": F.array_join("ops", "+"), "resources": cpu_gpu(F.col("categories"))}), *by, "op", "resources", "categories")


def resource_subplot(keyed: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Total time, and that of each single resource; what overlaps counts for each."""
    each = F.explode(F.array_union(F.array(F.lit("Total")), cpu_gpu(without_overhead(F.col("non_ops")))))
    busy = keyed.filter(F.size(without_overhead(F.col("non_ops"))) > 0)
    return _sums(busy.withColumn("resource", each), *by, "resource")


def profiling_overhead(keyed: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """``Corrected training time`` where the GPU is active or no overhead is; else the set of overheads."""
    over = F.array_sort(_only(F.col("non_ops"), OVERHEADS))
    real = F.array_contains("non_ops", GPU) | (F.size(over) == 0)
    return _sums(keyed.withColumn("overhead", F.when(real, F.array(F.lit("Corrected training time"))).otherwise(over)), *by, "overhead")


#: Labels of one step of the sums over supersets, and labels of a group up to which these steps are taken.
BLOCK, LATTICE_LABELS = 6, 60


def superset_sums(have: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """For each set that is ``wanted`` (by, set) the sum of all sets that hold it (``have``: by, set, s): ``by, set, s``; none if there is none.

    Each row of ``have`` is spread over the subsets of its labels, a few labels at a time: what is alike so far is added up, and what is no
    beginning of a wanted set goes, so sets never meet in pairs. Groups of more than ``LATTICE_LABELS`` labels meet by each wanted set's rarest label.
    """
    have, wanted = cut_lineage(have.select(*by, "set", "s")), cut_lineage(wanted.select(*by, "set").distinct())
    labels = have.select(*by, F.explode_outer("set").alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n"))
    counts = cut_lineage(labels.groupBy(*by).agg(F.count("label").alias("n_labels")))
    most = counts.agg(F.max("n_labels")).first()[0] or 0
    small = counts.filter(F.col("n_labels") <= LATTICE_LABELS).select(*by)
    few = labels.join(small, by, "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list("label")).alias("names"))
    blocks = [f"b{i}" for i in range(-(-min(most, LATTICE_LABELS) // BLOCK))]

    def coded(df: DataFrame) -> DataFrame:
        bits = F.transform("set", lambda x: F.array_position("names", x).cast("int") - 1)
        known = df.join(few, by).withColumn("bits", F.array_distinct(bits)).filter(~F.array_contains("bits", -1))

        def block(i: int) -> Column:
            own = F.filter("bits", lambda b: F.floor(b / BLOCK) == i)
            return F.aggregate(own, F.lit(0), lambda a, b: a + F.pow(F.lit(2), b % BLOCK).cast("int"))

        return known.withColumns({c: block(i) for i, c in enumerate(blocks)}).drop("names", "bits")

    spark = have.sparkSession
    subsets = spark.createDataFrame([(m, t) for m in range(2**BLOCK) for t in range(2**BLOCK) if m & t == t], "mask int, sub int")
    asked = cut_lineage(coded(wanted))
    sums = coded(have).groupBy(*by, *blocks).agg(F.sum("s").alias("s"))
    for i, c in enumerate(blocks):
        begun = [*by, *blocks[: i + 1]]
        spread = sums.join(F.broadcast(subsets), F.col(c) == F.col("mask")).drop(c, "mask").withColumnRenamed("sub", c)
        sums = spread.join(asked.select(*begun).distinct(), begun, "left_semi").groupBy(*by, *blocks).agg(F.sum("s").alias("s"))
    out = asked.join(sums, [*by, *blocks]).select(*by, "set", "s")
    if most <= LATTICE_LABELS:
        return out
    many = counts.filter(F.col("n_labels") > LATTICE_LABELS).select(*by)
    mine = wanted.join(many, by, "left_semi").select(*by, "set", F.explode("set").alias("label"))
    rarest = mine.join(labels, [*by, "label"]).groupBy(*by, "set").agg(F.min_by("label", F.struct("n", "label")).alias("label"))
    holding = have.join(many, by, "left_semi").select(*by, F.col("set").alias("above"), "s", F.explode(F.array_distinct("set")).alias("label"))
    met = rarest.join(holding, [*by, "label"]).filter(F.size(F.array_except("set", "above")) == 0).groupBy(*by, "set").agg(F.sum("s").alias("s"))
    everything = wanted.join(many, by, "left_semi").filter(F.size("set") == 0).join(have.groupBy(*by).agg(F.sum("s").alias("s")), by)
    return out.unionByName(met).unionByName(everything.select(*by, "set", "s"))


def venn_inclusive(sizes: DataFrame, by: list[str], labels: str = "region", size: str = "time_us") -> DataFrame:
    """Exclusive sizes of sets to inclusive ones: every set, and every single label, gets all that contain it."""
    have = cut_lineage(sizes.select(*by, F.col(labels).alias("set"), F.col(size).alias("s")))
    singles = have.select(*by, F.explode(F.transform("set", lambda x: F.array(x))).alias("set"))
    return superset_sums(have, have.select(*by, "set").union(singles), by).select(*by, F.col("set").alias(labels), F.col("s").alias(size))


def venn_exclusive(sizes: DataFrame, by: list[str], most: int, labels: str = "region", size: str = "time_us") -> DataFrame:
    """The way back: from the largest sets to the smallest (``most``: labels of the largest), less all strict supersets' exclusive sizes.

    Sets of size 0 are left out. Each level is written to the shared folder, as the next ones need it.
    """
    sizes = cut_lineage(sizes.select(*by, F.col(labels).alias("set"), F.col(size).alias("s")))
    levels = sorted((r[0] for r in sizes.select(F.size("set").alias("n")).filter(F.col("n").between(1, most)).distinct().collect()), reverse=True)
    done = sizes.limit(0)
    for n in levels:
        level = sizes.filter(F.size("set") == n)
        if n != levels[0]:
            less = superset_sums(done, level, by).withColumnRenamed("s", "less")
            level = level.join(less, [*by, "set"], "left").select(*by, "set", (F.col("s") - F.coalesce("less", F.lit(0))).alias("s"))
        done = cut_lineage(done.unionByName(level))
    return done.filter("s <> 0").select(*by, F.col("set").alias(labels), F.col("s").alias(size))


def stacked_sizes(sizes: DataFrame, by: list[str], labels: str = "region", size: str = "time_us") -> DataFrame:
    """Inclusive sizes less those of all strict supersets as they are (the legacy bar heights)."""
    have = cut_lineage(sizes.select(*by, F.col(labels).alias("set"), F.col(size).alias("s")))
    sums = superset_sums(have, have, by).withColumnRenamed("s", "all")
    return have.join(sums, [*by, "set"]).select(*by, F.col("set").alias(labels), (2 * F.col("s") - F.col("all")).alias(size))


def subplot_from_overlap(overlap: DataFrame, by: list[str], labels: str = "resources", size: str = "time_us") -> DataFrame:
    """Inclusive resource sizes to a subplot: each single one, and Total = singles less sets of several."""
    single = overlap.filter(F.size(labels) == 1).select(*by, F.get(labels, F.lit(0)).alias("resource"), F.col(size).alias(size))
    signed = F.when(F.size(labels) == 1, F.col(size)).otherwise(-F.col(size))
    return single.unionByName(overlap.groupBy(*by).agg(F.sum(signed).alias(size)).withColumn("resource", F.lit("Total")))


def self_overlap_ops(keyed: DataFrame, procs: str = "processes") -> DataFrame:
    """Names of operations with one entry for each process that runs it, sorted: ``ops`` may repeat."""
    return keyed.withColumn("ops", F.array_sort(F.flatten(F.transform("ops", lambda o: F.array_repeat(o, F.size(procs))))))


def operations_over_processes(regions: DataFrame) -> DataFrame:
    """Regions over all processes, of keys ``process/op:name`` and ``process/category``, by what runs: ``ops, categories, time_us``.

    ``ops`` is sorted and names an operation once for each process that runs it at the time; ``categories`` are a set.
    """
    names = F.transform("region", lambda x: F.substring_index(x, "/op:", -1))
    ops = F.array_sort(F.filter(names, lambda x: ~x.contains("/")))
    rest = F.filter("region", lambda x: ~x.contains("/op:"))
    categories = F.array_sort(F.array_distinct(F.transform(rest, lambda x: F.substring_index(x, "/", -1))))
    return regions.select(ops.alias("ops"), categories.alias("categories"), "time_us").filter("size(ops) > 0").groupBy("ops", "categories").agg(F.sum("time_us").alias("time_us"))


def total_size(exclusive: DataFrame, by: list[str], size: str = "time_us") -> DataFrame:
    return exclusive.groupBy(*by).agg(F.sum(size).alias(size))


def with_period(report: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Adds a whole report's start and end, as its output files state them."""
    w = Window.partitionBy(*by)
    return report.withColumns({"start_us": F.min("min_start_us").over(w), "end_us": F.max("max_end_us").over(w)})


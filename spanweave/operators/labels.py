"""Labels of report rows, and the critical path of dependent phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.plans.lineage import cut_lineage

#: Short names of categories.
SHORT = {"Simulator C": "Simulator", "Framework API C": "Backend", "CUDA API CPU": "CUDA"}


def short_category(category: Column) -> Column:
    return F.coalesce(*[F.when(category == long, short) for long, short in SHORT.items()], category)


def join_plus(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), " + ")


def split_plus(label: Column) -> Column:
    return F.split(label, r"\s+\+\s+")


def reduced_labels(rows: DataFrame, categories: str = "categories", resources: str = "resources") -> DataFrame:
    """Takes categories that are also resources anywhere in the report out of the categories, and shortens the others.

    Adds ``category``, the joined label; it is empty where only resources were active. The labels of a report are few.
    """
    named = rows.select(F.explode(categories).alias("c")).distinct().intersect(rows.select(F.explode(resources)).distinct())
    common = named.agg(F.collect_set("c").alias("__common"))
    left = F.transform(F.array_except(categories, "__common"), short_category)
    both = rows.join(F.broadcast(common)).withColumn(categories, F.array_sort(left)).drop("__common")  # one row
    return both.withColumn("category", join_plus(F.col(categories)))


def critical_path(phases: DataFrame, edges: DataFrame) -> DataFrame:
    """The longest time from a phase without predecessors to the end of each phase.

    ``phases``: ``phase, length`` (extrapolated time); ``edges``: ``before, after``. Returns ``phase, length, total,
    previous`` (the predecessor on the longest path, of equal ones the first by name; null at the start). The largest
    ``total`` is the whole training time. Each round carries totals one edge further, over joins; a graph of dependencies
    that has a cycle is an error.
    """
    phases = cut_lineage(phases.select("phase", F.col("length").cast("double").alias("length")))
    edges = cut_lineage(edges.select("before", "after").distinct())
    most = phases.count()
    totals = phases.select("phase", "length", F.col("length").alias("total"), F.lit(None).cast("string").alias("previous"))
    for _ in range(most + 1):
        reached = edges.join(totals.select(F.col("phase").alias("before"), F.col("total").alias("sofar")), "before")
        best = reached.groupBy(F.col("after").alias("phase")).agg(F.min(F.struct((-F.col("sofar")).alias("minus"), "before")).alias("b"))
        after = totals.join(best, "phase", "left").select("phase", "length", (F.col("length") - F.coalesce("b.minus", F.lit(0.0))).alias("total"), F.col("b.before").alias("previous"), F.col("total").alias("old"))
        after = cut_lineage(after)
        moved = not after.filter("total <> old").isEmpty()
        totals = after.drop("old")
        if not moved:
            return totals
    raise ValueError("the dependencies have a cycle")

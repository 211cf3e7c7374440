"""Whole numbers for names, kept between loads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.grid import numbered
from spanweave.plans.lineage import cut_lineage


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``name, id`` as they are kept at ``path``; none if nothing is there yet."""
    try:
        return spark.read.schema("name string, id long").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, id long")


def with_ids(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, id`` of the ``names`` that are not ``known`` yet: numbers after the greatest one given, in order of the names. A null is no name.

    New names are dealt by ranges and numbered in two steps: within a range, and over the ranges' counts, of which there is a row each.
    """
    fresh = names.select("name").filter("name is not null").distinct().join(known.select("name"), "name", "left_anti")
    # The range is written down with the name, so that a lost executor can't number names in another way.
    ranged = cut_lineage(fresh.repartitionByRange("name").select("name", F.spark_partition_id().alias("bucket")))
    given = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("given"))
    return numbered(ranged, [], [F.col("name")], "n").join(F.broadcast(given)).select("name", (F.col("given") + F.col("n")).alias("id"))


def add_names(names: DataFrame, path: str) -> DataFrame:
    """Adds the new ``names`` to the dictionary at ``path`` and returns it. One load at a time may write."""
    spark = names.sparkSession
    with_ids(names, dictionary(spark, path)).write.mode("append").parquet(path)
    return dictionary(spark, path)

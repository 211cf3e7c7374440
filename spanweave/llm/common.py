"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    One of our own is set only where that and the context's folder are both unset and Spark runs on one machine, as in tests;
    on a cluster without a folder this is an error.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drawn(share: float | Column, seed: str, *columns: str) -> Column:
    """Whether a row is in a sample of about this share of all rows, by a hash of its columns; no share above 0 is too small for it."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    most = F.lit((1 << 63) - 1)
    limit = F.when(share >= 1, most).otherwise(F.greatest(F.lit(1), F.floor(F.least(share, F.lit(0.999)) * float(1 << 63))).cast("long"))
    return F.xxhash64(*columns, F.lit(seed)).bitwiseAND(most) <= limit


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for few rows of much work each, which Spark would put into few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: A lookup table of at most so many rows is broadcast.
BROADCAST_ROWS = 50_000
#: A key with more than one in so many rows is a hot one; there are fewer of these than that, so they can be broadcast.
HOT_SHARE = 1000


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a table with one row a key (``small``) to a large one whose keys may be very uneven (``how``: left or inner).

    Keys compare null-safe. A small table is broadcast. Beyond ``BROADCAST_ROWS`` the rows of hot keys meet the few rows
    of ``small`` that have those keys by broadcast, wherever they lie, and only the others are shuffled: no key has more
    than a thousandth of the rows that are dealt by it. The columns of ``small`` other than ``key`` must not be columns
    of ``big``. ``rows``: as many as ``small`` has at most, where that is known; else they are counted.
    """
    renamed = small.withColumnRenamed(key, "__key")
    on = big[key].eqNullSafe(F.col("__key"))
    if (small.count() if rows is None else rows) <= BROADCAST_ROWS:
        return big.join(F.broadcast(renamed), on, how).drop("__key")
    counts = big.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    hot = cut_lineage(counts.join(counts.agg(F.sum("__n").alias("__all"))).filter(F.col("__n") * HOT_SHARE > F.col("__all")).select("__hot"))
    few = F.broadcast(renamed.join(F.broadcast(hot), F.col("__key").eqNullSafe(F.col("__hot")), "left_semi"))
    is_hot = big[key].eqNullSafe(F.col("__hot"))
    there = big.join(F.broadcast(hot), is_hot, "left_semi").join(few, on, how)
    return there.union(big.join(F.broadcast(hot), is_hot, "left_anti").join(renamed, on, how)).drop("__key")

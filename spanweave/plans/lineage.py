"""Cutting lineage through the folder that the cluster shares, and joins whose keys may be very uneven."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table of at most so many rows is broadcast.
BROADCAST_ROWS = 50_000
#: A key with more than one in so many rows is a hot one; there are fewer of these than that, so they can be broadcast.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``.

    One of one's own is used only where none is set and Spark runs on one machine; on a cluster that is an error.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _same(left: DataFrame, names: list[str], others: list[str]) -> Column:
    return reduce(Column.__and__, [left[a].eqNullSafe(F.col(b)) for a, b in zip(names, others, strict=True)])


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", is_small: bool | None = None) -> DataFrame:
    """Join a table with one row a key (``small``) to a large one (``how``: left or inner). Keys compare null-safe.

    A small table is broadcast; its rows are counted unless ``is_small`` says whether they are at most ``BROADCAST_ROWS``. Beyond ``BROADCAST_ROWS`` the rows of hot keys meet the few rows of ``small`` that have those
    keys by broadcast, wherever they lie, and only the others are shuffled: no key has more than a thousandth of the rows
    that are dealt by it. The other columns of ``small`` must not be columns of ``big``.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    renamed = small.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    if small.count() <= BROADCAST_ROWS if is_small is None else is_small:
        return big.join(F.broadcast(renamed), _same(big, keys, names), how).drop(*names)
    others = [f"__h{i}" for i in range(len(keys))]
    counts = big.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, others, strict=True)]).agg(F.count("*").alias("__n"))
    hot = F.broadcast(cut_lineage(counts.join(counts.agg(F.sum("__n").alias("__all"))).filter(F.col("__n") * HOT_SHARE > F.col("__all")).select(*others)))
    few = F.broadcast(renamed.join(hot, _same(renamed, names, others), "left_semi"))
    there = big.join(hot, _same(big, keys, others), "left_semi").join(few, _same(big, keys, names), how)
    return there.union(big.join(hot, _same(big, keys, others), "left_anti").join(renamed, _same(big, keys, names), how)).drop(*names)

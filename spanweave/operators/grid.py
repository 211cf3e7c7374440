"""Time buckets that hold about as many rows each, whatever the density of time, and next rows and row numbers by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.plans.lineage import BROADCAST_ROWS, cut_lineage, lookup

#: Rows of a bucket that is worked on as a whole, and of one in which all pairs are looked at.
ROWS, PAIR_ROWS = 20_000, 64
#: A bucket is split into so many at most at a time, at quantiles whose ranks are off by ``1 / ACCURACY`` of its rows at most.
FAN, ACCURACY = 256, 1024


@dataclass(frozen=True)
class Grid:
    """Bucket bounds of each group: for each level a table ``by (, bucket), splits, base`` and whether it is small.

    The first level splits a group, each further one the buckets of the level before; ``base`` is how many buckets of the new level
    lie before a bucket's own. Buckets of a group are numbered from 0 in order of time without gaps, and each holds a row of the
    table from which the grid was made. With a fixed ``width`` there are no tables.
    """

    by: list[str]
    levels: list[tuple[DataFrame, bool]]
    width: int | None = None

    def place(self, df: DataFrame, **times: str | Column) -> DataFrame:
        """Adds a column for each of ``times``: the bucket of that time. Rows of groups that the grid does not know are left out."""
        if self.width is not None:
            return df.withColumns({name: F.floor((F.col(t) if isinstance(t, str) else t) / self.width).cast("long") for name, t in times.items()})
        for n, (table, small) in enumerate(self.levels):
            if n == 0:
                df = lookup(df, table, self.by, "inner", small)
                df = df.withColumns({name: _passed(t) for name, t in times.items()}).drop("__splits", "__base")
                continue
            for name, t in times.items():
                df = lookup(df, table.withColumnRenamed("__bucket", name), [*self.by, name], "inner", small)
                df = df.withColumn(name, F.col("__base") + _passed(t)).drop("__splits", "__base")
        return df


def _passed(t: str | Column) -> Column:
    """How many of the sorted ``__splits`` are not above ``t``, by halving."""
    t, splits, steps = F.col(t) if isinstance(t, str) else t, F.col("__splits"), [FAN >> i for i in range(1, FAN.bit_length())]

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size(splits)) & (F.get(splits, at + step - 1) <= t), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further).cast("long")


def grid(df: DataFrame, by: list[str], t: str, rows: int = ROWS, width: int | None = None, first: Grid | None = None) -> Grid:
    """Buckets of about ``rows`` rows each, by the times ``t`` of each group's rows; or of a fixed ``width``.

    Bounds are quantiles of the times, from a sketch that is merged, so bursts, gaps and single far rows make no bucket larger. Only
    rows of one and the same time are never parted. A group of more than ``FAN`` buckets is split again level by level. ``df`` is
    read once a level, and should be written out or cheap. ``first``: a grid of the same rows, to be split further.
    """
    if width is not None:
        return Grid(by, [], width)
    at = df.select(*by, F.col(t).alias("__t"))
    made, levels, keys = Grid(by, []), [], by
    if first is not None:
        levels = list(first.levels)
        at, keys = first.place(at, __bucket="__t"), [*by, "__bucket"]
    while True:
        quantiles = F.percentile_approx("__t", [i / FAN for i in range(1, FAN)], ACCURACY)
        found = at.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__t").alias("__lo"), quantiles.alias("__q"))
        parts = F.least(F.lit(FAN), F.ceil(F.col("__n") / rows)).cast("int")
        chosen = F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda i: F.get("__q", F.ceil(i * FAN / parts).cast("int") - 1))
        # Above the smallest time, so that a bucket before a split is never empty; each other one holds its split.
        splits = F.when(parts > 1, F.array_distinct(F.filter(chosen, lambda s: s > F.col("__lo")))).otherwise(F.array().cast("array<bigint>"))
        table = found.select(*keys, "__n", splits.alias("__splits"))
        if levels:
            before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
            table = table.withColumn("__base", F.coalesce(F.sum(F.size("__splits") + 1).over(before), F.lit(0)))
        else:
            table = table.withColumn("__base", F.lit(0).cast("long"))
        table = cut_lineage(table)
        large = F.max(F.when(F.size("__splits") > 0, F.col("__n")))
        size, most = table.agg(F.count("*"), large).first()
        levels.append((table.drop("__n"), size <= BROADCAST_ROWS))
        made = Grid(by, list(levels))
        if most is None or most <= rows * FAN:
            return made
        at, keys = made.place(df.select(*by, F.col(t).alias("__t")), __bucket="__t"), [*by, "__bucket"]


def following(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the next row of the group. ``df`` has a ``bucket``, which goes up with the order.

    Within a bucket that is a window; a bucket's last row gets the first value of the next one, of which there is one row a bucket.
    """
    first = df.groupBy(*by, "bucket").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    ahead = first.withColumn("__ahead", F.lead("__first").over(Window.partitionBy(*by).orderBy("bucket"))).drop("__first")
    within = Window.partitionBy(*by, "bucket").orderBy(*order)
    last = F.lead(F.lit(True)).over(within).isNull()
    return df.join(ahead, [*by, "bucket"]).withColumn(name, F.when(last, F.col("__ahead")).otherwise(F.lead(value).over(within))).drop("__ahead")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, … in the order of each group. ``df`` has a ``bucket``, which goes up with the order; the buckets' counts are added up."""
    sizes = df.groupBy(*by, "bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(*by, "bucket", before.alias("__before"))
    return df.join(ahead, [*by, "bucket"]).withColumn(name, F.col("__before") + F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order))).drop("__before")

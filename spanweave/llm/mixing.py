"""Mixing sources to target weights: nested hash thresholds from histograms, without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import WORD, cut_lineage, lookup, table

#: A document's hash has LEVELS * LEVEL_BITS bits; each level of the histogram looks at LEVEL_BITS of them.
LEVELS, LEVEL_BITS = 3, 12
BITS = LEVELS * LEVEL_BITS


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """A document's place in the sampling order: the first bits of an MD5 of its id."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Each source's target: ``share`` of all sizes dealt by weight, at most ``most`` times a source's size.

    ``sources`` has one row a source (``source, source_size``). Sources in order of code points, null last,
    take the weights in turn. What a full source can't take goes to the others by weight; that is filling
    to a common level, found from running sums over the sources in the order in which they fill. The sources are one task:
    they are few beside the documents.
    """
    one = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    fill = one.orderBy("full_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(one) - before) / open_weight)
        # The first source in the order that doesn't fill sets the level; to those after it a level can only come out lower.
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(one))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, h`` of each document: its words, and its place in the sampling order."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("h"))


def plan(sizes: DataFrame, weights: list[float], share: float = 1.0, most: float = 2.0) -> DataFrame:
    """``source, source_size, target, whole, threshold``: how a mix takes each source. ``sizes`` is what ``sized`` gives, written out.

    Every document is taken ``whole`` times, ``floor(target / source_size)``; of the rest of its source's target, whole
    documents are taken whose place is below the threshold that comes nearest. That is found without sorting: sizes are
    summed by source and hash bucket, and only the bucket on the boundary is looked at more finely, level by level. Where a
    place is that of several documents, these are taken or left together.
    """
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = cut_lineage(by_source.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))

    edge = wanted.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = BITS - level * LEVEL_BITS
        inside = lookup(sizes, edge, "source", "inner").filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "budget", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        passed = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("budget"))
        first = passed.groupBy("source", "budget").agg(F.min_by(F.struct("bucket", "n", "upto"), "bucket").alias("b"))
        edge = cut_lineage(first.select("source", "budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.n")).alias("below"), F.col("b.n").alias("n")))
        if level < LEVELS:
            edge = edge.drop("n")
    # The last bucket is one hash value: take it if that comes nearer than leaving it. Where nothing passes the budget, all is taken.
    nearer = F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")
    limit = edge.select(F.col("source").alias("s"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    both = wanted.join(limit, wanted["source"].eqNullSafe(limit["s"]), "left")
    return both.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(1 << BITS)).alias("threshold"))


def times() -> Column:
    """How often a document (with its ``size`` and ``h``) is taken by its source's ``plan``; without a word, never."""
    return F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How much of each document a weighted mix of sources takes, by ``plan``.

    Uses columns ``doc_id, text, source``; others are ignored. Returns ``doc_id, source, size, source_size, target, taken``,
    one row for each row of ``docs``. A null or empty text has size 0 and is taken 0 times; a null source is a source; a very
    long text counts whole. Documents of one id (a null id, too) and repeated rows have one place and are taken or left
    together. Reruns agree. An empty table gives no rows.
    """
    sizes = cut_lineage(sized(docs, seed))
    found = lookup(sizes, plan(sizes, weights, share, most), "source")
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0).drop("source")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()), cap) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), g AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (p.whole + CASE WHEN g.upto <= p.target - p.whole * p.source_size
    OR (g.upto - g.n <= p.target - p.whole * p.source_size
        AND g.upto - (p.target - p.whole * p.source_size) < (p.target - p.whole * p.source_size) - (g.upto - g.n)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""

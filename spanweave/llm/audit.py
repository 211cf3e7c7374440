"""Audit of how filters interact, in every order: a packed bitmap index of failures, labels and parts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import WORD, cut_lineage, lookup, table

#: A part's counts: of all documents, and of those with each label.
COUNTS = ["n", "good", "toxic"]


def index(parts: np.ndarray, flags: np.ndarray, n_flags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bitmap index of some rows: distinct parts, the first byte of each one's run, its bitset, and a bitset per flag.

    Rows are put in order of their parts and every part begins at a byte, so that a part's bitset is 0 outside its own run of
    bytes and only that is held; bits that fill up a run's last byte are 0 in all bitsets.
    """
    names, part, sizes = np.unique(parts, return_inverse=True, return_counts=True)
    widths = -(-sizes // 8)
    firsts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
    order = np.argsort(part, kind="stable")
    within = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(firsts * 8, sizes) + within
    bits = np.zeros((n_flags + 1, int(widths.sum()) * 8), dtype=bool)
    bits[0, at] = True
    for f in range(n_flags):
        bits[f + 1, at] = (flags[order] >> f) & 1
    packed = np.packbits(bits, axis=1)
    return names, firsts, packed[0], packed[1:]


def counted(parts: np.ndarray, flags: np.ndarray, n_filters: int, n_labels: int) -> pd.DataFrame:
    """For each part and subset of the filters: rows that fail none of the subset, and how many of these have each label.

    ``flags`` has a bit a filter (1: the row fails it), then a bit a label. A subset's survivors are the part's bitset AND NOT
    those of its filters; each subset's bitset comes from that of a smaller one.
    """
    names, firsts, everyone, sets = index(parts, flags, n_filters + n_labels)
    alive, out = {0: everyone}, []
    for subset in range(1 << n_filters):
        if subset:
            last = subset.bit_length() - 1
            alive[subset] = alive[subset & ~(1 << last)] & ~sets[last]
        held = [alive[subset], *(alive[subset] & sets[n_filters + label] for label in range(n_labels))]
        sums = [np.add.reduceat(np.bitwise_count(b).astype(np.int64), firsts) for b in held]
        out.append(pd.DataFrame({"part": names, "subset": subset} | dict(zip(COUNTS, sums, strict=True))))
    return pd.concat(out, ignore_index=True)


def subset_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """``part, subset, n, good, toxic``: documents that fail no filter of the subset (a bit each), over all rows of ``part, flags``.

    Each batch of rows is counted where it lies; only its counts are shuffled and added up, so a part of any size is no task of its own.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield counted(batch["part"].to_numpy(dtype=object), batch["flags"].to_numpy(dtype=np.int64), n_filters, len(COUNTS) - 1)

    found = rows.select("part", "flags").mapInPandas(count, "part string, subset int, n long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _orders(names: str) -> Column:
    """All orders and their steps, as an array of structs: a table fixed by the number of filters."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append({"filter_order": "".join(names[i] for i in order), "step": step, "f": f, "before": before})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,f:int,before:int>>")


def interactions(rows: DataFrame, names: str) -> DataFrame:
    """What each filter removes, by part, order of the filters and step.

    ``rows`` has ``part`` and ``flags``: bit i is set if the document fails the filter ``names[i]``, then a bit for a good and one
    for a toxic document; other columns are ignored. Returns ``part, filter_order, step`` and counts of documents: ``kept`` after the
    step, ``removed`` by it, ``redundant`` (fail its filter, but were removed earlier), ``unique_fails`` (fail no other filter),
    ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``, the filter's removed summed over all orders. Zeros are
    included. A null part is the empty string, null flags are 0; repeated rows count one by one; an empty table gives no rows.
    """
    m = len(names)
    clean = rows.select(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("flags", F.lit(0)).cast("int").alias("flags"))
    counts = subset_counts(clean, m)
    # 2**m rows a part, put in order of their subsets.
    packed = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *COUNTS))).alias("s"))

    def of(subset: Column, count: str = "n") -> Column:
        return F.get(F.col(f"s.{count}"), subset)

    bit = F.expr("shiftleft(1, f)")
    after = F.col("before").bitwiseOR(bit)
    removed = of(F.col("before")) - of(after)
    fails = of(F.lit(0)) - of(bit)
    others = F.lit((1 << m) - 1).bitwiseXOR(bit)
    # What a filter removes depends on the set before it alone, and so many orders put that set first and the filter next.
    orders = ", ".join(f"{math.factorial(n) * math.factorial(m - 1 - n)}L" for n in range(m))
    gain = f"if((shiftright(b, i) & 1) = 1, 0L, array({orders})[bit_count(b)] * (s.n[b] - s.n[b | shiftleft(1, i)]))"
    shares = F.expr(f"transform(sequence(0, {m - 1}), i -> aggregate(sequence(0, {(1 << m) - 1}), 0L, (sum, b) -> sum + {gain}))")
    steps = packed.withColumn("shares", shares).select("part", "s", "shares", F.inline(_orders(names)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        of(after).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (of(others) - of(F.lit((1 << m) - 1))).alias("unique_fails"),
        (of(F.col("before"), "good") - of(after, "good")).alias("good_lost"),
        (of(F.col("before"), "toxic") - of(after, "toxic")).alias("toxic_lost"),
        F.get("shares", F.col("f")).alias("shapley"),
    )


def repeated_texts(texts: DataFrame) -> DataFrame:
    """``digest, first_id`` of the texts (by their ``digest``) that documents of several ids have: the smallest id."""
    spans = texts.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return spans.filter("first_id < last_id").select("digest", "first_id")


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, flags, digest`` of each document: its part, the SHA-256 of its text, and bits 0 to 3 of ``flags``.

    These are set for fewer than 200 words; for under half as many distinct words as words; for over 2 % capital letters A-Z; for
    any of ``#$%&*|``. A null text is empty; a null source is the part ``""``. Words are case-sensitive.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORD.replace("^", "")), lambda w: w != "")
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words)
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        F.size("words") < 200,
        100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        100 * capitals > 2 * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    flags = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return named.select("doc_id", "part", flags.alias("flags"), F.unhex(F.sha2("text", 256)).alias("digest"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How five filters of documents interact, in all 120 orders: ``interactions`` of A to D (see ``failures``) and E, repeated texts.

    A document fails E if a document of a smaller id has the same text (the same SHA-256), whatever its part. Uses ``doc_id, text,
    source`` of ``docs`` and ``doc_id, quality, toxic`` of ``labels``; others are ignored. A null id is not smaller or larger than
    any and has no label; of several labels of an id any 1 counts. Repeated rows count one by one, very long texts whole; an empty
    table gives no rows. Texts are read once; what is joined is as short as a digest.
    """
    rows = cut_lineage(failures(docs))
    seen = lookup(rows, repeated_texts(rows), "digest").withColumn("again", (F.col("doc_id") > F.col("first_id")).cast("int"))
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    known = lookup(seen.select("doc_id", "part", "flags", "again"), marked.filter("good = 1 or bad = 1"), "doc_id")
    bits = [F.col("flags"), *(F.coalesce(c, F.lit(0)) * (1 << i) for i, c in enumerate(["again", "good", "bad"], 4))]
    return interactions(known.select("part", sum(bits, F.lit(0)).alias("flags")), "ABCDE")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), f AS (
  SELECT part,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails,
    coalesce(l.good, false) AS good, coalesce(l.bad, false) AS bad
  FROM w LEFT JOIN (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) l ON w.doc_id = l.id
), n AS (
  SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM n a, n b, n c, n d, n e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT array_to_string(list_transform(p, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(n.i AS INTEGER) AS step, p[n.i] AS i,
    list_transform([1, 2, 3, 4, 5], lambda x: list_position(p, x) < n.i) AS before
  FROM o, n
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY part, fails
), m AS (
  SELECT *, fails[i] AS this,
    (fails[1] AND before[1]) OR (fails[2] AND before[2]) OR (fails[3] AND before[3]) OR (fails[4] AND before[4]) OR (fails[5] AND before[5]) AS gone,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM g, s
), r AS (
  SELECT part, filter_order, step, i,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT this), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND this), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND this), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (this AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND this), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(bad) FILTER (NOT gone AND this), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM r
"""

"""Near-duplicates by Jaccard similarity of word shingles, missing none: a prefix-filtered join and exact counts.

Shingles have one order for all texts: that of their hashes, with shingles that many texts have put last. Of two sets
with a similarity of at least 0.8, one shingle is among the first ``size // 5 + 1`` of either, so those are the keys
under which texts meet. In a large group of copies with many changes each, those are the changes, and what all have in
common is a key only of texts with few changes. How many keys two texts share bounds what they can have in common; few
pairs are left after that, and the whole texts of those are compared. Sets are made from the texts each time they are needed: written out, they
would take more room than the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import cut_lineage, lookup, shuffle_partitions
from spanweave.llm.graph import components

#: Words of a shingle. The similarity asked for is 4/5, which ``alike`` and ``prefix`` have in whole numbers.
SHINGLE = 5
#: A shingle that is a key of more texts than this is put last in the order. Any value gives the same pairs.
COMMON = 64
#: At most so many common shingles (8 bytes each) are broadcast; with more, the sets of the texts that have any are shuffled.
BROADCAST_COMMON = 1_000_000
#: At most so many hashes of texts (8 bytes each, and their sets' numbers) are broadcast; with more the texts are shuffled.
BROADCAST_HASHES = 500_000
#: Characters of texts that a worker handles at once, unless one text is longer.
CHUNK = 250_000
#: Texts that are compared with one text within a task.
FAN = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, whose constants are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text (A-Z as a-z); a shorter text is one run, one without words has none."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    flat = np.array(list(chain.from_iterable(words)), dtype=object)
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    n, runs = len(h) - size + 1, np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] if n > 0 else runs
    runs = _mixed(runs).view(np.int64)
    out, at = [], 0
    for w in words:
        if len(w) >= size:
            out.append(np.unique(runs[at : at + len(w) - size + 1]))
        else:
            short = np.full(min(1, len(w)), len(w), np.uint64)
            for x in h[at : at + len(w)]:
                short = short * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(_mixed(short).view(np.int64))
        at += len(w)
    return out


def _in_chunks(texts: pd.Series, size: int = CHUNK):
    """Lists of neighbouring texts of about ``size`` characters."""
    part, length = [], 0
    for t in texts:
        part.append(t)
        length += len(t or "")
        if length >= size:
            yield part
            part, length = [], 0
    if part:
        yield part


def _node(s: np.ndarray) -> int:
    """A set's number: a hash of its sorted members, 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else 0


def shingles(text: Column) -> Column:
    """``shingle_sets`` of a column of whole texts, as array<long>."""

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([s for part in _in_chunks(texts) for s in shingle_sets(part)])

    return F.pandas_udf(made, "array<long>")(text)


def _summaries(texts: pd.Series) -> pd.Series:
    return pd.Series([_node(s) for part in _in_chunks(texts) for s in shingle_sets(part)], dtype="int64")


def _common(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which members are in ``common`` (sorted)."""
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)


def _first(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, those of ``common`` last, and how many of it these are."""
    last = _common(s, common)
    first = np.concatenate([s[~last], s[last]])[: len(s) // 5 + 1]
    return first, max(0, len(first) - int((~last).sum()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``CHUNK`` bytes of ``text``: a worker has the sets of one slice at a time, however many rows a batch has."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(ends)]
        yield from (batch.slice(at, to - at) for at, to in pairwise(cuts) if at < to)


def _longs(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key``: the prefixes by hash of all sets."""
    for part in _parts(batches):
        yield pa.RecordBatch.from_arrays([_longs([s[: len(s) // 5 + 1] for s in shingle_sets(part.column("text").to_pylist())])], ["key"])


PREFIXED = "version long, node long, n int, first array<long>, n_common int"


def _prefixes(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's set (``PREFIXED``), of rows of ``version, text``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = shingle_sets(part.column("text").to_pylist())
            first = [_first(s, common) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f) for f, _ in first)]), pa.int32()), _longs([f for f, _ in first]))
            columns = [part.column("version"), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), lists, pa.array([n for _, n in first], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["version", "node", "n", "first", "n_common"])

    return made


def _all_if_common(common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``key``: all members of the sets that have one of ``common`` in their prefixes by hash."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sets = shingle_sets(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([_longs([s for s in sets if _common(s[: len(s) // 5 + 1], common).any()])], ["key"])

    return made


def prefix(size: Column) -> Column:
    return F.floor(size / 5).cast("int") + 1


def alike(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with so many in common have a similarity of 4/5 or more."""
    return 9 * shared >= 4 * (a + b)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text``, one row for each of ``wanted`` (``node, version``)."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_HASHES else wanted
    found = docs.select("text", F.xxhash64("text").alias("v")).join(wanted, F.col("v") == F.col("version"))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, version, n, first, n_common`` of each set that has members, once; and the common shingles (``key``)."""
    nothing = np.zeros(0, np.int64)
    first = docs.select("text").mapInArrow(_prefix_keys, "key long")
    common = cut_lineage(first.groupBy("key").count().filter(F.col("count") > COMMON).select("key"))
    known = _known(common)
    if known is not None:
        # What else the texts with such a shingle have in common with many of them, and not in their prefixes only.
        every = docs.select("text").mapInArrow(_all_if_common(known), "key long")
        common = cut_lineage(every.groupBy("key").count().filter(F.col("count") > COMMON).select("key"))
        known = _known(common)
    made = docs.select(F.xxhash64("text").alias("version"), "text").mapInArrow(_prefixes(nothing if known is None else known), PREFIXED)
    once = made.groupBy("node").agg(F.first(F.struct("version", "n", "first", "n_common")).alias("x"))
    nodes = cut_lineage(once.filter("x.n > 0").select("node", "x.*"))  # filtered here, as a filter before would make all sets twice
    return (nodes, common) if known is not None else _reordered(docs, nodes, common)


def _known(common: DataFrame) -> np.ndarray | None:
    """The common shingles, sorted, if they are few enough for every worker to hold them."""
    return np.sort(common.toArrow()["key"].to_numpy()) if common.count() <= BROADCAST_COMMON else None


def _reordered(docs: DataFrame, nodes: DataFrame, common: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same where the common shingles are too many for a worker: by joins."""
    moved = cut_lineage(nodes.select("node", "n", "version", F.explode("first").alias("key")).join(common, "key", "left_semi").select("node", "n", "version").distinct())
    every = cut_lineage(_texts(docs, moved.select("node", "version")).select("node", F.explode(shingles(F.col("text"))).alias("key")))
    common = cut_lineage(every.groupBy("key").count().filter(F.col("count") > COMMON).select("key"))
    marked = every.join(common.withColumn("last", F.lit(True)), "key", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    order = marked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("last", "key"))).alias("s")).join(moved, "node")
    first = F.slice("s", 1, prefix(F.col("n")))
    after = order.select("node", "version", "n", F.transform(first, lambda x: x["key"]).alias("first"), F.size(F.filter(first, lambda x: x["last"])).alias("n_common"))
    return cut_lineage(nodes.join(moved.select("node"), "node", "left_anti").unionByName(after)), common


def _shared(nodes: DataFrame, common: DataFrame) -> DataFrame:
    """``key, node, centre, many`` for every key of two sets or more.

    Common keys (``many``) are put together before they are shuffled, and their centre is the set with the fewest other
    shingles; of the others, which few sets have, it is the smallest node, and they are dealt out once.
    """
    keys = nodes.select("node", (F.size("first") - F.col("n_common")).alias("rare"), F.explode("first").alias("key"))
    marks = common.withColumn("many", F.lit(True))
    marked = keys.join(F.broadcast(marks), "key", "left") if common.count() <= BROADCAST_COMMON else lookup(keys, marks, "key")
    by_key = Window.partitionBy("key")
    few = marked.filter("many is null").select("key", "node", F.min("node").over(by_key).alias("centre"), F.max("node").over(by_key).alias("most"), F.lit(False).alias("many"))
    hot = marked.filter("many").select("key", "node", "rare")
    ends = hot.groupBy("key").agg(F.min(F.struct("rare", "node")).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    ends = cut_lineage(ends.select("key", F.col("c.node").alias("centre")))
    return cut_lineage(few.filter("centre < most").drop("most").union(lookup(hot, ends, "key", "inner").select("key", "node", "centre", F.lit(True).alias("many"))))


def _can_be_alike(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``a, b`` of the pairs (``a, b, s``: keys in common that are not common ones) that can have a similarity of 4/5.

    The prefix that ends first holds all members up to its end, so of that set no more than the keys in common and what
    comes after its prefix can be in the other.
    """
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "keys", "n_common", "end")]), side)
    shared = F.col("s") + F.least("a_n_common", "b_n_common")
    most = shared + F.when(F.col("a_end") <= F.col("b_end"), F.col("a_n") - F.col("a_keys")).otherwise(F.col("b_n") - F.col("b_keys"))
    return pairs.filter(alike(F.least(most, "a_n", "b_n"), F.col("a_n"), F.col("b_n"))).select("a", "b")


def _alike_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, known = [], None, np.zeros(0, np.int64)
    for x, y in zip(a, b, strict=True):
        if x is not last:
            last, known = x, shingle_sets([x])[0]
        other = shingle_sets([y])[0]
        out.append(9 * len(np.intersect1d(known, other, assume_unique=True)) >= 4 * (len(known) + len(other)))
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose whole texts are alike. A text with many partners is compared with parts of them in several tasks."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, cut_lineage(nodes.join(wanted, "node", "left_semi").select("node", "version")))
    fans = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fan")))
    dealt = lookup(pairs, fans, "a", "inner").withColumn("part", F.pmod(F.xxhash64("b"), F.col("fan")))
    right = dealt.select("a", "b", "part").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    left = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part")).join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = right.repartition(shuffle_partitions(pairs), "a", "part").join(left, ["a", "part"])
    return cut_lineage(both.select("a", "b", F.pandas_udf(_alike_texts, "boolean")("ta", "tb").alias("same"))).filter("same").select("a", "b")


def linked(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``node, root`` of every set that is joined with another by pairs of similarity 4/5 or more.

    Pairs that were found in another way (``near``: a, b), and each set with that centre with which it shares most keys, are
    compared first, which joins large groups of copies without all their pairs; then all that share a key and aren't joined yet.
    """
    nodes, common = _nodes(docs)
    end = F.struct((F.col("n_common") > 0).alias("common"), F.element_at("first", -1).alias("key"))
    sizes = cut_lineage(nodes.select("node", "n", F.size("first").alias("keys"), "n_common", end.alias("end")))
    shared = _shared(nodes, common)
    rare = F.count_if(~F.col("many")).alias("s")
    nearest = shared.filter("node <> centre").groupBy("node", "centre").agg(rare, F.count("*").alias("n_keys")).groupBy("node").agg(F.max(F.struct("n_keys", "centre", "s")).alias("x"))
    nearest = nearest.select(F.col("x.centre").alias("a"), F.col("node").alias("b"), "x.s")
    first = _can_be_alike(nearest, sizes)
    if near is not None:
        first = first.union(near).distinct()
    edges = _verified(first, docs, nodes)
    roots = components(edges)
    # Of a set with common shingles among its keys all others are keys, too: with a set with which it shares none of those, it has no more than the rest in common.
    rest = F.col("n") - F.when(F.col("n_common") > 0, F.col("keys") - F.col("n_common")).otherwise(0)
    known = sizes.select("node", "n", rest.alias("rest")).join(roots, "node", "left").select("node", "n", "rest", F.coalesce("root", "node").alias("r"))
    rooted = shared.select("key", "node", "many").join(known, "node")
    several = rooted.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("key")
    rooted = cut_lineage(rooted.join(several, "key", "left_semi"))
    left, right = (rooted.select(F.col("key").alias(f"k{x}"), F.col("many").alias(f"many{x}"), F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("r", "n", "rest")]) for x in "ab")
    on = (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
    most = F.when(F.col("manya"), F.least("resta", "restb")).otherwise(F.least("na", "nb"))
    met = left.join(right, on & alike(most, F.col("na"), F.col("nb"))).groupBy("a", "b").agg(F.count_if(~F.col("manya")).alias("s"))
    more = _verified(_can_be_alike(cut_lineage(met), sizes), docs, nodes)
    return roots if more.isEmpty() else components(edges.union(more))


def near_duplicates(docs: DataFrame, prints: Column | None = None, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Component of each document: texts with a similarity of 4/5 or more are linked.

    Uses ``doc_id, text``; others are ignored. Texts with the same shingles are one node, as are all null and empty
    texts and those without words; ties in size and repeated rows are linked like any other; a very long text is worked on
    whole. Returns ``doc_id, print (long: the set's number), version (a hash of the text), root (long), component_id``, one
    row for each row of ``docs``: ``root`` names the component, ``component_id`` is its smallest doc_id, null if it has
    none. An empty table gives no rows. Shingles, sets and texts count as equal if their 64-bit hashes are.

    ``candidates`` makes pairs ``a, b`` to begin with of ``own`` (the set's number) and ``fingerprint`` (``prints``) of all texts.
    """
    docs = docs.select("doc_id", "text")
    listed = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("version"), F.pandas_udf(_summaries, "long")("text").alias("own"), *([] if prints is None else [prints.alias("fingerprint")])))
    near = None if candidates is None else candidates(listed.select("own", "fingerprint"))
    rooted = cut_lineage(lookup(listed, linked(docs, near).withColumnRenamed("node", "own"), "own").select("doc_id", "version", F.col("own").alias("print"), F.coalesce("root", "own").alias("root")))
    firsts = cut_lineage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return lookup(rooted, firsts, "root").select("doc_id", "print", "version", "root", "component_id")

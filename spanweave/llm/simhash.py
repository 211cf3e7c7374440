"""SimHash near-duplicates: Golay-code fuzzy keys find the fingerprints to compare."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm import jaccard
from spanweave.llm.common import cut_lineage, lookup, shuffle_partitions, table
from spanweave.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: The fingerprint's segments (first bit, bits). With 3 errors in 3 segments, either one segment has none and
#: another at most one, or each has one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A text's fingerprint, unsigned. Bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in text], dtype=np.uint64).view(np.int64))


def prints(text: Column) -> Column:
    """Fingerprints of whole texts, as long."""
    return F.pandas_udf(_fingerprints, "long")(text)


GENERATOR, CODE_BITS, DATA_BITS = 0b101011100011, 23, 12


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial of the Golay code."""
    rest = words.astype(np.int64)
    for bit in range(CODE_BITS - 1, CODE_BITS - DATA_BITS - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - (CODE_BITS - DATA_BITS))), rest)
    return rest


@cache
def _errors() -> np.ndarray:
    """For each syndrome, the one error pattern of weight up to 3 that has it: the code is perfect."""
    patterns = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(CODE_BITS), k)])
    table = np.zeros(1 << (CODE_BITS - DATA_BITS), dtype=np.int64)
    table[_syndrome(patterns)] = patterns
    return table


def codeword(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of 23-bit words."""
    return (words ^ _errors()[_syndrome(words)]) >> (CODE_BITS - DATA_BITS)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct values of each row, at most six, filled up with -1."""
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return np.sort(rows, axis=1)[:, -6:]


def _ragged(rows: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """The values of each row that are there."""
    return np.split(rows[there], np.cumsum(there.sum(axis=1))[:-1]) if len(rows) else []


def fuzzy_keys(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the two sides of the join for each fingerprint (uint64).

    A segment's wide keys are the codewords nearest to it and to all words one bit away: one or six. Words at
    distance 1 have this in common: the nearest codeword of either is a wide key of the other. So with wide
    keys on one side and the nearest codeword on the other, segments with up to one error meet. Tags 0 to 5:
    a segment alike (the one of the smaller or the larger number first) and one with up to one error. Tag 6:
    all three with up to one error, two of them wide on the left and one on the right.
    """
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [codeword(p) for p in parts]
    flips = [np.stack([codeword(p), *(codeword(p ^ (1 << b)) for b in range(bits))], axis=1) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    wide = [_distinct(f) for f in flips]
    there = [w >= 0 for w in wide]
    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    tags = [((tag << 40) | (parts[i] << DATA_BITS))[:, None] for tag, (i, _) in enumerate(pairs)]
    both = (wide[0][:, :, None] << (2 * DATA_BITS)) | (wide[1][:, None, :] << DATA_BITS)
    all_left = [*(t | wide[j] for t, (_, j) in zip(tags, pairs, strict=True)), (6 << 40) | both.reshape(len(prints), -1) | near[2][:, None]]
    left_there = [*(there[j] for _, j in pairs), (there[0][:, :, None] & there[1][:, None, :]).reshape(len(prints), -1)]
    all_right = [*(t | near[j][:, None] for t, (_, j) in zip(tags, pairs, strict=True)), (6 << 40) | ((near[0] << (2 * DATA_BITS)) | (near[1] << DATA_BITS))[:, None] | wide[2]]
    right_there = [*(np.ones((len(prints), 1), bool) for _ in pairs), there[2]]
    return _ragged(np.hstack(all_left), np.hstack(left_there)), _ragged(np.hstack(all_right), np.hstack(right_there))


def _keys(prints: pd.Series) -> pd.DataFrame:
    left, right = fuzzy_keys(prints.to_numpy(dtype=np.int64).view(np.uint64))
    return pd.DataFrame({"l": left, "r": right})


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a, b`` (a < b) of distinct fingerprints (column ``print``, long) that differ in up to ``radius`` (at most 3) bits."""
    if radius > 3:
        raise ValueError("the segments hold for up to 3 bits")
    dealt = nodes.select("print").distinct().repartition(shuffle_partitions(nodes), "print")  # few bytes of much work each
    keyed = cut_lineage(dealt.withColumn("k", F.pandas_udf(_keys, "struct<l:array<long>,r:array<long>>")("print")))
    left = keyed.select(F.col("print").alias("a"), F.explode("k.l").alias("key"))
    right = keyed.select(F.col("print").alias("b"), F.explode("k.r").alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def candidates(listed: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of texts' numbers (``own, fingerprint``) that Golay keys bring together, two for each text at most.

    Of the texts of one fingerprint the smallest is paired with each other one, and with that of the smallest fingerprint that links at ``RADIUS`` bits.
    0, the number of texts without words, has no pair.
    """
    texts = cut_lineage(listed.filter("own <> 0").groupBy("own").agg(F.min("fingerprint").alias("print")))
    firsts = cut_lineage(texts.groupBy("print").agg(F.min("own").alias("centre"), F.max("own").alias("most")))
    copies = lookup(texts, firsts.filter("centre < most").select("print", F.col("centre").alias("a")), "print", "inner").filter("own <> a").select("a", F.col("own").alias("b"))
    nearest = cut_lineage(links(texts).groupBy("b").agg(F.min("a").alias("a")))
    n = firsts.count()
    for side in "ab":
        nearest = lookup(nearest, firsts.select(F.col("print").alias(side), F.col("centre").alias(f"own_{side}")), side, "inner", n)
    return copies.union(nearest.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))


def near_duplicates(docs: DataFrame, radius: int | None = None) -> DataFrame:
    """Fingerprint and component of each document.

    Without a ``radius``, texts link where their five-word shingles have a similarity of 0.8 or more, which is about
    10 differing bits. Fingerprints and Golay keys find those at ``RADIUS`` or fewer (``candidates``), whose texts are then compared.
    More bits are too many for the segments: the pairs that are not joined by then are found and counted by ``jaccard.near_duplicates``. ``print`` is then the number of the text's set of shingles, with more columns than listed here. What follows is for a ``radius``.

    Uses columns ``doc_id, text``; others are ignored. Texts of one fingerprint are one node, so that copies
    are never paired with each other; nodes link at ``radius`` or fewer differing bits.

    Returns ``doc_id, print (long), component_id``, one row for each row of ``docs``: the smallest doc_id that
    can be reached, itself included. Null and empty texts and those without words have print 0 and link like
    any other. Null ids are never a component's id; if it has no other, that is null. Repeated rows stay. An
    empty table gives no rows.
    """
    if radius is None:
        return jaccard.near_duplicates(docs, prints(F.col("text")), candidates)
    printed = cut_lineage(docs.select("doc_id", prints(F.col("text")).alias("print")))
    nodes = cut_lineage(printed.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, radius))
    rooted = cut_lineage(nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root")))
    firsts = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    joined = cut_lineage(lookup(rooted, firsts, "root").select("print", "component_id"))
    return lookup(printed, joined, "print", "inner").select("doc_id", "print", "component_id")


def hex_print(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op9_simhash_golay(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), RADIUS)
    return found.select("doc_id", hex_print(F.col("print")).alias("fingerprint"), "component_id")

"""Quality rules: base counts, and divergence of a document's histograms from language references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import cut_lineage, table

SPACE = r"[\x20\x09-\x0D]"
#: Classes of characters; what is in none of them is the last class. No character is in two.
CHAR_CLASSES = ("[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[.,;:!?]", r"[^\x00-\x7F]", SPACE)
#: Common words of some languages. Fixed values; a language that isn't here has its reference on the same bins.
COMMON_WORDS = tuple(
    dict.fromkeys(
        "the of and to in a is that for on with was "  # English
        "der die und ist das ein nicht zu den von mit auf "  # German
        "le la les et des un est que pour dans en du "  # French
        "el los las y es por con una se del no al".split()  # Spanish
    )
)


@dataclass(frozen=True)
class Rules:
    """``max_distance``: above it the verdict is to drop. A document with fewer than ``min_words`` words is not compared; a
    language with fewer than ``min_reference`` words gives no reference, and its documents are compared with those there are."""

    max_distance: float = 0.25
    min_words: int = 50
    min_reference: int = 1000


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    n = F.size(words) - 2
    windows = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))
    return F.coalesce(windows, F.array().cast("array<bigint>"))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each whole text. Words are runs of anything but ASCII white space; a null text has none."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("text")).withColumn("words", F.array_remove(F.split("text", f"{SPACE}+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.filter(F.transform("words", F.lower), lambda w: w.isin(*COMMON_WORDS))
    counts = [F.regexp_count("text", F.lit(c)).alias(f"c{i}") for i, c in enumerate(CHAR_CLASSES)]
    df = df.select("doc_id", "lang", F.length("text").alias("n_chars"), F.size("words").cast("long").alias("n_words"), *counts, _windows(F.col("words")).alias("windows"), lines.alias("lines"), common.alias("common"))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    df = df.withColumn("pairs", F.when(~distinct, pairs).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    alike = lambda x, i: (x["h"] == F.get("pairs", i - 1)["h"]) | (x["h"] == F.get("pairs", i + 1)["h"])
    places = F.sort_array(F.transform(F.filter("pairs", lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x["at"]))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    classes = [F.col(f"c{i}") for i in range(len(CHAR_CLASSES))]
    rest = F.col("n_chars") - sum(classes, F.lit(0))
    hits = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS]
    return df.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("n_chars") - F.col(f"c{len(CHAR_CLASSES) - 1}")).cast("long").alias("word_chars"),
        F.col("c2").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.array(*classes, rest).alias("chars"),
        F.array(*hits, F.col("n_words").cast("int") - F.size("common")).alias("bins"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _shares(counts: Column, n: int) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / n)))


def references(counted: DataFrame, min_reference: int) -> DataFrame:
    """One row: an array with the shares of character classes and common words of every language.

    They are sums over all documents of known language that pass the base rules.
    """
    n_chars, n_bins = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("bins")[i]).alias(f"b{i}") for i in range(n_bins)]
    by_lang = counted.filter(~F.col("base_failed") & F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).filter(F.col("n") >= min_reference)
    arrays = by_lang.select("lang", F.array(*[f"c{i}" for i in range(n_chars)]).alias("c"), F.array(*[f"b{i}" for i in range(n_bins)]).alias("b"))
    shared = arrays.select(F.struct("lang", _shares(F.col("c"), n_chars).alias("chars"), _shares(F.col("b"), n_bins).alias("bins")).alias("r"))
    return shared.agg(F.sort_array(F.collect_list("r")).alias("refs"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def term(x: Column, y: Column) -> Column:
        half = F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        return half + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of each document.

    Uses ``doc_id, text, lang``; others are ignored. A document is kept unless the base rules fail (under 50
    words, or over half of the words in repeated 3-word windows) or its distance from every language's
    reference is above the limit; the distance is the mean of the Jensen-Shannon distances of the character
    classes and of the common words. ``lang`` only groups the references.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept``,
    one row for each row of ``docs``. Null and empty texts have counts of 0, fail the base rules and have no
    distance. Without any reference, the base rules decide. Repeated rows are judged alike and count as often as they are
    there; a very long text is counted whole; at the limit itself a document is kept. An empty table gives no rows.
    """
    counted = cut_lineage(features(docs))
    refs = references(counted, rules.min_reference)
    n_chars, n_bins = len(CHAR_CLASSES) + 1, len(COMMON_WORDS) + 1
    shares = counted.withColumn("p", _shares(F.col("chars"), n_chars)).withColumn("w", _shares(F.col("bins"), n_bins))
    both = shares.join(F.broadcast(refs))  # one row; its size is that of the list of languages
    distances = F.transform("refs", lambda r: (js_distance(F.col("p"), r["chars"]) + js_distance(F.col("w"), r["bins"])) / 2)
    both = both.withColumn("distance", F.when(F.col("n_words") >= rules.min_words, F.array_min(distances)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= rules.max_distance, F.lit(True))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("distance")


def _bins_sql() -> str:
    return "[" + ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))" for w in COMMON_WORDS) + "]"


def _chars_sql() -> str:
    return "[" + ", ".join(f"len(regexp_extract_all(text, '{c}'))" for c in CHAR_CLASSES) + "]"


OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), u AS (
  SELECT row_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w
), g AS (
  SELECT row_id, pos, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY row_id ORDER BY pos)
), r AS (
  SELECT row_id, pos FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row_id, a, b, c) > 1
), n AS (
  SELECT row_id, count(DISTINCT pos + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY row_id
), f AS (
  SELECT w.row_id, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    {_chars_sql()} AS c0, length(text) AS n_chars, list_transform(words, lambda x: lower(x)) AS lw
  FROM w LEFT JOIN n ON w.row_id = n.row_id
), e AS (
  SELECT *, list_append(c0, n_chars - list_sum(c0)) AS chars, {_bins_sql()} AS b0,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), h AS (
  SELECT *, list_append(b0, n_words - list_sum(b0)) AS bins FROM e
), x AS (
  SELECT row_id, lang, base_failed, n_words, 'c' AS kind, unnest(chars) AS v, unnest(range(len(chars))) AS i FROM h
  UNION ALL SELECT row_id, lang, base_failed, n_words, 'b', unnest(bins), unnest(range(len(bins))) FROM h
), s AS (
  SELECT row_id, kind, i, CASE WHEN sum(v) OVER t > 0 THEN v / sum(v) OVER t ELSE 1.0 / count(*) OVER t END AS p
  FROM x WINDOW t AS (PARTITION BY row_id, kind)
), q AS (
  SELECT lang, kind, i, sum(v) / sum(sum(v)) OVER (PARTITION BY lang, kind) AS q FROM x
  WHERE NOT base_failed AND lang IN (SELECT lang FROM h WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= 1000)
  GROUP BY lang, kind, i
), j AS (
  SELECT row_id, lang, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM s JOIN q USING (kind, i) GROUP BY row_id, lang, kind
), m AS (
  SELECT row_id, min(d) AS distance FROM (SELECT row_id, lang, avg(js) AS d FROM j GROUP BY row_id, lang) GROUP BY row_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(distance <= 0.25, true) AS kept
FROM h LEFT JOIN m USING (row_id)
"""

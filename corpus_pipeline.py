"""A corpus pipeline of five stages: language ID, line dedup, near-duplicates, mixing, BPE.

``STAGES`` lists them; ``run`` applies them to ``documents``. Each stage's result is written as Parquet to the
cluster's shared folder and read again as the next one's documents. All stages but the last keep the columns of
their input; each works on all that the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import bpe, langid, linededup, mixing, simhash
from spanweave.llm.common import cut_lineage, lookup, shared_folder, table

#: A document whose predicted language has a lower score than this is rejected, as is one without a letter.
MIN_SCORE = 0.5
#: Sources take these weights in turn; the mix has MIX_SHARE of all words, and no document is taken over MIX_MOST times.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2.0


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, ``row``, so that no column of the input clashes with one of a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: without a letter, or with a score under ``MIN_SCORE``.

    The model learns from the text and the non-null ``lang`` of all but a fixed fold of ``docs``. Where there is
    no language to learn from, only documents without a letter go. Ties and repeated rows are judged alike.
    """
    model = langid.fit(docs.filter(langid.fold("doc_id", 4) != 2))
    judged = docs.withColumn("__language", langid.with_language(docs, model))
    known = (F.col("__language.lang_pred") != langid.UNKNOWN) & (F.col("__language.score") >= MIN_SCORE)
    if not model.languages:
        known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return judged.filter(known).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat or nearly repeat earlier lines; a document that loses all its lines goes.

    Null texts, and texts without a line with a word, stay as they are. Repeated rows are one document, and are cut alike; of
    lines that are as early as each other the one with the smaller number stays. An empty table gives none.
    """
    counts = F.col("counts")
    left = counts["n_lines"] - counts["n_exact"] - counts["n_near"]
    kept = linededup.dedup_rows(docs).filter((counts["n_lines"] == 0) | (left > 0))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return kept.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"row.`{f.name}`") for f in docs.schema])


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of five-word shingles 0.8 or more) the document with the smallest doc_id stays; of repeated rows, one.

    Documents with a null doc_id stay only where nothing else of their group has an id, one a group. Null and empty texts
    are one group. An empty table gives none.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("print"), F.col("version").alias("v"))
    group = simhash.near_duplicates(docs).groupBy("root", order.alias("at")).agg(F.count("*").alias("rows"))
    firsts = cut_lineage(group.groupBy("root").agg(F.min(F.struct("at", "rows")).alias("x")).select("x.at.id", "x.at.v", "x.rows"))
    def those(wanted: DataFrame) -> DataFrame:
        same = F.col("d.own").eqNullSafe(F.col("w.id")) & (F.col("d.version") == F.col("w.v"))
        return docs.select(whole(docs), F.col("doc_id").alias("own"), F.xxhash64("text").alias("version")).alias("d").join(wanted.alias("w"), same, "left_semi")

    repeated = those(firsts.filter("rows > 1")).dropDuplicates(["own", "version"]) if not firsts.filter("rows > 1").isEmpty() else None
    kept = those(firsts.filter("rows = 1"))
    return (kept if repeated is None else kept.union(repeated)).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Documents without a word stay as they are.

    How often follows from a document's source and id alone, so no text is shuffled. Repeated rows, and rows of one source
    with the same id, are taken alike. An empty table gives none.
    """
    sizes = cut_lineage(mixing.sized(docs))
    plan = cut_lineage(mixing.plan(sizes, MIX_WEIGHTS, MIX_SHARE, MIX_MOST))
    rows = docs.select(whole(docs), "source", mixing.words(F.col("text")).alias("size"), mixing.place(F.col("doc_id"), "mix").alias("h"))
    n = F.when(F.col("size") == 0, 1).otherwise(mixing.times()).cast("int")
    return lookup(rows, plan, "source").select("row", F.explode(F.array_repeat(F.lit(1), n))).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text (a null text is an empty one), and whether decoding gives the text back.

    Repeated rows are encoded alike, very long texts whole; an empty table gives none. Returns ``doc_id, source, n_tokens, ids`` (binary, little-endian unsigned 32-bit integers) and ``round_trip``.
    """
    import public_tokenizers

    coded = docs.select("doc_id", "source", "text", bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).alias("c"))
    same = F.col("c.decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"), F.col("c.ids").alias("ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", copies_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """What the next stage has read is not needed any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: No SQL: the stages learn models and hash texts in ways that SQL doesn't have. Tests hold the last four, and the whole run,
#: against plain Python.
ORACLE_SQL = None

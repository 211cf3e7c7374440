"""URL filters: host and path rules, and boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import cut_lineage, drawn, lookup, table

#: At most about so many labelled URLs are used for training, by a hash of the URL.
MAX_TRAIN = 20_000
#: Statistics of suffixes, for the training rows, leave out the row's own one of so many folds.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host_length", "f_depth", "f_labels", "f_hyphens", "f_digits", "f_entropy", "f_params", "f_suffix"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (host, path, verdict) that fits, as struct<rule, verdict>, or null."""

    def one(rule_host: str, rule_path: str, verdict: str) -> Column:
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        return F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[one(*r) for r in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds lexical features of ``url`` (with ``host`` and ``path`` there already), and its ``suffix``."""
    url = F.coalesce("url", F.lit(""))
    chars = F.split(url, "")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")

    def bits(c: Column) -> Column:
        share = (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
        return F.when((c == "") | (share <= 0), 0.0).otherwise(-share * F.log2(share))

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return (
        pages.withColumn("f_length", F.length(url).cast("double"))
        .withColumn("f_host_length", F.length("host").cast("double"))
        .withColumn("f_depth", F.regexp_count("path", F.lit("/")).cast("double"))
        .withColumn("f_labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("f_hyphens", F.regexp_count("host", F.lit("-")).cast("double"))
        .withColumn("f_digits", F.regexp_count(url, F.lit("[0-9]")) / n)
        .withColumn("f_entropy", F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + bits(c)))
        .withColumn("f_params", F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """A verdict for each URL: the longest fitting rule's, else that of boosted trees.

    Uses ``page_id, url``; others are ignored. The trees are trained on labelled URLs: ``labels`` (``url,
    verdict``: block or allow) if given, else the URLs that a rule decides. About ``max_train`` of them are
    used, half of them blocked where there are as many, chosen by a hash of the URL and weighted back; statistics of host suffixes (smoothed share of blocked ones) come from
    all of them, for training without the row's own fold. Where rules give the labels, a suffix is neutral (0.5)
    if it is itself a rule's host, or if its labels are of one kind: that says what the rules list, not what its
    other URLs are. With no labelled URL all are allowed; with labels of one kind only, that is the verdict.

    Returns ``page_id, host, path, rule, verdict, score``, one row for each row of ``pages``; ``score`` is the
    trees' probability to block, null where they weren't asked; at 0.5 a URL is blocked. Null URLs have an empty host and
    path. Rules of one length are tried in order of host, path and verdict. Repeated rows, rows with a null page_id and very
    long URLs are judged like any other; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    df = lexical(df.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules)))
    if labels is None:
        known = df.filter("hit is not null").withColumn("label", (F.col("hit.verdict") == "block").cast("double"))
    else:
        host, path = host_and_path(F.col("url"))
        known = lexical(labels.select("url", "verdict").filter("verdict is not null").withColumn("host", host).withColumn("path", path))
        known = known.withColumn("label", (F.col("verdict") == "block").cast("double"))
    fold, blocks = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int"), F.sum("label")
    others = [(F.sum(F.when(fold != i, F.col("label")).otherwise(0.0)) + 1) / (F.count(F.when(fold != i, 1)) + 2) for i in range(FOLDS)]
    suffixes = known.groupBy("suffix").agg(((blocks + 1) / (F.count("*") + 2)).alias("f_suffix"), F.array(*others).alias("f_others"), ((blocks > 0) & (blocks < F.count("*"))).alias("both"))
    if labels is None:
        suffixes = suffixes.filter(F.col("both") & ~F.col("suffix").isin([host for host, _, _ in rules]))
    suffixes = suffixes.drop("both")
    n, blocked = known.agg(F.count("*"), F.sum("label")).first()
    hit = [F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict")]
    if not n or blocked in (0, n):
        only = "block" if n and blocked else "allow"
        return df.select("page_id", "host", "path", hit[0], F.coalesce("hit.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))

    def vectors(part: DataFrame, training: bool = False) -> DataFrame:
        joined = lookup(part, suffixes, "suffix")
        joined = joined.withColumn("f_suffix", F.coalesce(F.get("f_others", fold) if training else F.col("f_suffix"), F.lit(0.5)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined.drop("f_others"))

    share = {1.0: min(1.0, max_train / 2 / blocked), 0.0: min(1.0, max_train / 2 / (n - blocked))}  # of either kind alike, so that a rare one is learned
    own = F.when(F.col("label") == 1, share[1.0]).otherwise(share[0.0])
    chosen = known.filter(drawn(own, "url", "url")).withColumn("weight", min(share.values()) / own)
    train = cut_lineage(vectors(chosen, True).select("label", "features", "weight").coalesce(8))
    model = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=7, maxMemoryInMB=128, weightCol="weight").fit(train)
    scored = model.transform(vectors(df))
    p = vector_to_array("probability")[1]
    verdict = F.coalesce("hit.verdict", F.when(p >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", hit[0], verdict.alias("verdict"), F.when(F.col("hit").isNull(), p).alias("score"))


#: Fixed values of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)

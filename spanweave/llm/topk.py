"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of a block of queries; a task holds one of each. Each row is sent once to each block of
#: the other side, so what is shuffled falls with the size of the blocks.
ROW_BLOCK, QUERY_BLOCK = 4096, 8192
#: Scores that are accumulated side by side.
SCORES = 1 << 17


def quantize(vector: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _dense(rows: list[np.ndarray]) -> np.ndarray:
    """The rows' weights by term (component), 0 where a row has none."""
    dense = np.zeros((max((len(r) for r in rows), default=0), len(rows)), dtype=np.int64)
    for i, r in enumerate(rows):
        dense[: len(r), i] = r
    return dense


def _scores(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of n rows for each of the queries (term, query), one term at a time: its weighted posting is scattered into the dense scores."""
    scores = np.zeros((queries.shape[1], n), dtype=np.int64)
    for given, (at, w) in zip(queries, postings, strict=False):
        asked = np.flatnonzero(given)
        if not len(asked) or not len(at):
            continue
        if len(asked) == len(given) and len(at) == n:
            scores += given[:, None] * w
        else:
            scores[np.ix_(asked, at)] += given[asked, None] * w
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, by partition selection."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int):
    schema = ["query_id", "vec_id", "score"]

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in schema})
        ids, weights = rows["id"].to_numpy(dtype=np.int64), _dense(list(rows["weights"]))
        postings = [(at, term[at]) for term in weights for at in [np.flatnonzero(term)]]
        asked, wanted = queries["id"].to_numpy(dtype=np.int64), _dense(list(queries["weights"]))
        found, step = [], max(1, SCORES // len(ids))
        for first in range(0, len(asked), step):
            for query_id, scores in zip(asked[first : first + step], _scores(wanted[:, first : first + step], postings, len(ids)), strict=True):
                others = np.flatnonzero(ids != query_id)
                best = others[_best(scores[others], ids[others], k)]
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(found, ignore_index=True).astype("int64")

    return search


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of the highest inner product for each query, exactly.

    ``rows`` and ``queries`` have columns ``id`` (long) and ``weights`` (array of long); other columns are
    ignored. Every block of queries meets every block of rows once: the sparse weights of a query scatter
    into a dense array of scores, one term at a time; the k best of each block are then merged.

    Returns ``query_id, rank (from 1), vec_id, score``. Ties go to the smaller id. A query is not matched
    with rows of its own id. Rows with a null id or null weights take no part, an empty array scores 0
    with everything; vectors of unequal lengths are compared on the components both have. Repeated rows
    are ranked one by one; a query id is one query, of several vectors the smallest. Empty tables give no rows.
    Scores are 64-bit integers. The work is that of all pairs, by definition.
    """
    rows = rows.select("id", "weights").filter("id is not null and weights is not null")
    queries = queries.select("id", "weights").filter("id is not null and weights is not null").groupBy("id").agg(F.min("weights").alias("weights"))

    def blocks(df: DataFrame, n: int) -> int:
        return max(1, -(-df.count() // n))

    n_rows, n_queries = blocks(rows, row_block), blocks(queries, query_block)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Each row with its own block and with every block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("id", "weights"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(queries, "qb", n_queries, "rb", n_rows).groupBy("qb", "rb")
    right = dealt(rows, "rb", n_rows, "qb", n_queries).groupBy("qb", "rb")
    found = left.cogroup(right).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table

    all_rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), quantize(F.col("embedding")).alias("weights"))
    return exact_top_k(all_rows, all_rows.filter("id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Centroid clustering with annulus search: exact nearest centroids among those whose norm is near enough."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import table

#: Components are at most so large, so that a squared distance over 64 of them is below 2**63.
LARGEST = 1 << 27
#: Norms and roots are rounded; bounds are widened by this share of them, and never narrowed by rounding.
SLACK = 1e-9


def kept(vectors: pa.ListArray, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have exactly ``dim`` components, none null or non-finite, and these as floor(scale * x)."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    ok = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(ok)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(ok), dim)  # a null is a NaN
    fine = np.isfinite(values).all(axis=1)
    whole = np.floor(scale * values[fine])
    if whole.size and np.abs(whole).max() > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST}: squared distances would not fit 64 bits")
    return ok[fine], whole.astype(np.int64)


class Annulus:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.order], centroids[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each row; of equally near ones the smallest number.

        The distance to the centroid with the nearest norm bounds a vector's distance to its own; by the triangle inequality that
        one's norm differs from the vector's by no more. Binary search finds the run of those norms. They are compared in
        whole numbers, from the nearest norm outwards; the bound falls as nearer ones are found, and what lies on it is compared.
        """
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        slack = SLACK * (1 + size + self.norms[-1])
        right = np.clip(np.searchsorted(self.norms, size), 1, max(1, len(self.norms) - 1))
        left = right - 1
        right = np.minimum(right, len(self.norms) - 1)
        at = np.where(np.abs(self.norms[left] - size) <= np.abs(self.norms[right] - size), left, right)
        number, best = self.order[at], self._squared(x, at)
        radius = np.sqrt(best.astype(np.float64)) + slack
        low, high = np.searchsorted(self.norms, size - radius, "left"), np.searchsorted(self.norms, size + radius, "right")
        for step in range(1, len(self.norms)):
            for j in (at - step, at + step):
                rows = np.flatnonzero((j >= low) & (j < high))
                rows = rows[np.abs(self.norms[j[rows]] - size[rows]) <= radius[rows]]
                if not len(rows):
                    continue
                d, n = self._squared(x[rows], j[rows]), self.order[j[rows]]
                better = (d < best[rows]) | ((d == best[rows]) & (n < number[rows]))
                rows = rows[better]
                best[rows], number[rows] = d[better], n[better]
                radius[rows] = np.sqrt(best[rows].astype(np.float64)) + slack[rows]
        return number, best

    def _squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[at]) ** 2).sum(axis=1)


def _mapped(vectors: DataFrame, dim: int, scale: float, schema: str, each: Callable[[pa.Array, np.ndarray], dict]) -> DataFrame:
    """``each`` of the kept vectors (ids, components) of every batch, as columns."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = kept(batch.column("vector"), dim, scale)
            yield pa.RecordBatch.from_pydict(each(batch.column("id").take(pa.array(rows)), x))

    return vectors.mapInArrow(mapped, schema)


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: float, key: Column) -> np.ndarray:
    """The k kept vectors with the smallest keys, in their order; of one key the smaller components first, null keys last."""
    all_kept = _mapped(vectors, dim, scale, f"id {dict(vectors.dtypes)['id']}, x array<long>", lambda ids, x: {"id": ids, "x": pa.array(list(x), type=pa.list_(pa.int64()))})
    rows = all_kept.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows
    return np.array([r.x for r in rows], dtype=np.int64).reshape(len(rows), dim)


def sums_by_cluster(vectors: DataFrame, centroids: np.ndarray, dim: int, scale: float) -> list:
    """``cluster, n, inertia, total`` of each cluster: rows, squared distances and the components' sums; k rows.

    Each batch is summed before the shuffle, so a cluster is never one task's rows.
    """
    search = Annulus(centroids)

    def each(ids: pa.Array, x: np.ndarray) -> dict:
        number, d = search.nearest(x)
        found = np.unique(number)
        inside = [number == c for c in found]
        total = pa.array([x[i].sum(axis=0) for i in inside], type=pa.list_(pa.int64()))
        return {"cluster": pa.array(found, type=pa.int32()), "n": pa.array([int(i.sum()) for i in inside], type=pa.int64()), "inertia": pa.array([int(d[i].sum()) for i in inside], type=pa.int64()), "total": total}

    parts = _mapped(vectors, dim, scale, "cluster int, n long, inertia long, total array<long>", each)
    sums = F.array(*[F.sum(F.col("total")[i]) for i in range(dim)])
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), sums.alias("total")).collect()


def clusters(vectors: DataFrame, k: int, rounds: int, dim: int, scale: float, key: Column) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """Clusters of vectors around centroids of whole numbers, found in ``rounds`` rounds.

    ``vectors`` has columns ``id`` and ``vector`` (an array of numbers); others are ignored. Vectors that are null or not of exactly
    ``dim`` components, or that hold a null, NaN or infinity, take no part. Components become floor(scale * x); one beyond 2**27 is an
    error, as squared distances would not fit. The centroids start as the k vectors with the smallest ``key`` (a column of
    ``id``); where there are fewer vectors, as so many. A round assigns every vector to the nearest centroid (ties: the smaller
    number) and moves each centroid that has vectors to the floor of their mean, exactly. Then all are assigned once more.

    Returns ``id, cluster, distance`` (squared), one row a vector that takes part, the centroids and each cluster's summed
    distance. Null and repeated ids and rows count one by one. An empty table gives no rows. The vectors are read anew in each
    round; k * dim numbers travel to and from the driver.
    """
    vectors = vectors.select("id", "vector")
    centroids = first_centroids(vectors, k, dim, scale, key)
    for _ in range(rounds if len(centroids) else 0):
        for row in sums_by_cluster(vectors, centroids, dim, scale):
            centroids[row.cluster] = [s // row.n for s in row.total]
    inertia = {r.cluster: r.inertia for r in sums_by_cluster(vectors, centroids, dim, scale)} if len(centroids) else {}
    search = Annulus(centroids) if len(centroids) else None

    def each(ids: pa.Array, x: np.ndarray) -> dict:
        number, d = search.nearest(x) if search else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return {"id": ids, "cluster": pa.array(number, type=pa.int32()), "distance": pa.array(d, type=pa.int64())}

    return _mapped(vectors, dim, scale, f"id {dict(vectors.dtypes)['id']}, cluster int, distance long", each), centroids, inertia


def op12_annulus_clusters(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    found, centroids, inertia = clusters(vectors, k=16, rounds=3, dim=64, scale=64.0, key=key)
    rows = [(c, n, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    out = found.join(F.broadcast(by_cluster), "cluster").withColumn("inertia", F.lit(sum(inertia.values())).cast("long"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS MATERIALIZED (
  SELECT r, i, w[i] AS x FROM v, (SELECT unnest(range(1, {dim + 1})) AS i)
), c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS INTEGER) AS c, i, w[i] AS y
  FROM (SELECT w, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, w) AS n FROM v), (SELECT unnest(range(1, {dim + 1})) AS i)
  WHERE n <= {k}
)"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n
    FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{t} USING (i) GROUP BY r, c))
  WHERE n = 1
)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c{t}.c, c{t}.i, CASE WHEN m.n IS NULL THEN y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y
  FROM c{t} LEFT JOIN (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN e USING (r) GROUP BY c, i) m ON c{t}.c = m.c AND c{t}.i = m.i
)""")
    return f"""{", ".join(steps)}, h AS (
  SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h ON a.c = h.c
"""


OP12_SQL = _op12_sql()

"""Plain Lloyd clustering in whole numbers.

Components become ``floor(scale * x)``.  Centroids are broadcast (``k`` times ``dims`` numbers, whatever the table); each task takes squared
differences to one centroid after another in numpy and gives the lowest index of the least.  A round shuffles one row of whole sums for each
partition and centroid, which ``groupBy`` merges, so results don't depend on partitions.  The first centroids are the ``k`` vectors
whose ids' hashes come first; each task sends its own ``k``.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part and don't come out; a vector without
an id is assigned and counted, but is no first centroid; repeated rows count each, and of equal hashes the smaller components come first;
ties go to the lower centroid; empty centroids stay; with fewer vectors than centroids each of them is one; components beyond
2**27 after scaling count as that, so that distances fit a long; a sum of distances that doesn't is null; extra columns aren't looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, map_arrow, materialise, table

K = 40
DIMS = 64
SCALE = 256
ROUNDS = 5
SEED = 2
#: Components are held within this, so that ``dims`` squares of differences fit a long.
LARGEST = 1 << 27
#: Rows that are compared with a centroid together.
STEP = 4096


def whole(column: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and their components as whole numbers."""
    if not pa.types.is_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero((sizes == dims) & np.asarray(column.is_valid()))
    starts = column.offsets.to_numpy()[at]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    x = values[starts[:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(x[good] * scale)
    return at[good], np.clip(x, -LARGEST, LARGEST).astype(np.int64)


def closest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest of the nearest centroids of each row, and the squared distance."""
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        reach = max(np.abs(part).max(initial=0), np.abs(centroids).max(initial=0))
        # squares of small differences are summed in half the width
        kind = np.int32 if 4 * int(reach) ** 2 * part.shape[1] < 1 << 31 else np.int64
        rows, means = part.astype(kind), centroids.astype(kind)
        squares = np.empty((len(means), len(rows)), np.int64)
        for j, mean in enumerate(means):
            differ = rows - mean
            squares[j] = np.einsum("ij,ij->i", differ, differ)
        best = squares.argmin(axis=0)
        cluster[at : at + STEP], distance[at : at + STEP] = best, squares[best, np.arange(len(rows))]
    return cluster, distance


def _vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))


def first_centroids(vectors: DataFrame, *, k: int = K, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """The vectors whose ids' hashes come first, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            at, x = whole(batch.column(1), dims, scale)
            ids = batch.column(0).to_pylist()
            keys = [(hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), j) for j, i in enumerate(at) if ids[i] is not None]
            # whole rows are compared among the first only, so equal hashes are kept up to the k-th
            last = sorted(h for h, _ in keys)[:k][-1:]
            best = sorted(best + [(h, x[j].tolist()) for h, j in keys if h <= last[0]])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], names=["hash", "v"])

    found = map_arrow(_vectors(vectors, vec_id, embedding), run, "hash string, v array<long>").orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), dims)


def step(vectors: DataFrame, centroids: np.ndarray, *, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """One round: every centroid that has vectors becomes the floor of their mean."""
    k, dims = centroids.shape
    names = [f"s{j}" for j in range(dims)]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            _, x = whole(batch.column(0), dims, scale)
            cluster, _ = closest(x, shared.value)
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), *(pa.array(sums[some, j]) for j in range(dims))], names=["cluster", "n", *names])

    parts = map_arrow(vectors.select(F.col(embedding).alias("embedding")), run, f"cluster int, n long, {', '.join(f'{c} long' for c in names)}")
    moved = centroids.copy()
    for r in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # k rows at most
        moved[r.cluster] = np.array([r[c] for c in names], np.int64) // r.n
    shared.destroy()
    return moved


def fit(vectors: DataFrame, *, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Centroids after ``rounds`` of Lloyd's algorithm."""
    centroids = first_centroids(vectors, k=k, dims=dims, scale=scale, seed=seed, vec_id=vec_id, embedding=embedding)
    for _ in range(rounds if len(centroids) else 0):
        moved = step(vectors, centroids, scale=scale, vec_id=vec_id, embedding=embedding)
        if np.array_equal(moved, centroids):  # further rounds would change nothing
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, *, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) of the vectors that take part."""
    dims = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(1), dims, scale)
            if len(shared.value):
                cluster, distance = closest(x, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return map_arrow(_vectors(vectors, vec_id, embedding), run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors that take part."""
    centroids = fit(vectors, k=k, dims=dims, scale=scale, rounds=rounds, seed=seed, vec_id=vec_id, embedding=embedding)
    rows = materialise(assign(vectors, centroids, scale=scale, vec_id=vec_id, embedding=embedding), "assigned")
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows at most

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    inertia = fits(sum(sums.values()))
    known = [(j, fits(sums[j]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist()) if j in sums]
    of = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED) -> str:
    square = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT".format(n=dims)
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash, x) - 1 AS cluster, x
  FROM (SELECT sha256('{seed}:' || vec_id) AS hash, x FROM v WHERE vec_id IS NOT NULL ORDER BY hash, x LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, min({{'distance': {square}, 'cluster': cluster}}) AS best, any_value(v.x) AS x FROM v, c{r} c GROUP BY row
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS x FROM (
      SELECT best.cluster AS cluster, i, floor(sum(x[i]) / count(*))::BIGINT AS mean FROM a{r}, range(1, {dims} + 1) t(i) GROUP BY best.cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance,
  (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.cluster
"""


#: Sums of whole numbers far below 2**53 over counts: the quotient's floor is exact in doubles.
OP11_SQL = _sql()

"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its ``prefix`` nearest pivots in order, and posted
in the inverted file of each of them with its rank there.  A query adds up, over the files of its own pivots, how far ranks
differ (a pivot outside a prefix counts as rank ``prefix``): the footrule distance.  The ``share`` of a stretch of rows
with the smallest distances is reranked by exact cosine: first in double precision, then what may be among the best in twice that, rounded
once, so that scores don't depend on a row's place and vectors of one direction tie.

Rows stay where they are: each task indexes its rows in stretches of ``stretch`` and keeps each query's best; queries come
in blocks of at most ``block`` vectors, which is all that is broadcast.  Every row is indexed.  Recall on the test tables
is in the README.

Edge cases: vectors of any finite size are scaled first, so that no square over- or underflows; rows without an id take no part;
extra columns aren't looked at; vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of another length than a
query's are no candidates; a query never finds rows with its own id; repeated rows are candidates each; ties
go to the smaller id, at the border of what is reranked as well; equal vectors of a stretch are posted by their smallest ids; with fewer candidates than asked for all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import textscan as ts
from .frames import map_arrow, table

PIVOTS = 512
PREFIX = 64
SHARE = 0.2
LEAST = 64
STRETCH = 8192
BLOCK = 8192
SAMPLE_ROWS = 4096
#: Twice what rounding can change of a cosine of unit vectors, and more.
SLACK = 1e-9


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector takes part."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).where(whole).where(F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as doubles; each row by a power of two, which is exact, so that its largest component is near 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Block:
    """Queries of one length with their permutations."""

    ids: np.ndarray
    vectors: np.ndarray
    prefixes: np.ndarray


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    prefix = min(prefix, near.shape[1])
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


class InvertedFiles:
    """Postings of some rows: for each pivot the rows whose prefix holds it, with their ranks."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        n, prefix = prefixes.shape
        self.rows, self.prefix = n, prefix
        order = np.argsort(prefixes.ravel(), kind="stable")
        self.row, self.rank = order // prefix, order % prefix
        self.at = np.concatenate([[0], np.cumsum(np.bincount(prefixes.ravel(), minlength=pivots))])

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of each row to a query's prefix, up to a constant."""
        sizes = self.at[query + 1] - self.at[query]
        postings = ts.expand(self.at[query], sizes)
        mine, theirs = np.repeat(np.arange(len(query)), sizes), self.rank[postings]
        # against a row that lacks the pivot: its own distance to the end of both prefixes falls away
        gain = np.bincount(self.row[postings], 2 * self.prefix - mine - theirs - np.abs(mine - theirs), self.rows).astype(np.int64)
        return -gain


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a + b`` as a double and what it lacks."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a * b`` as a double and what it lacks."""

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = 134217729.0 * x  # 2**27 + 1
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _dot(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of rows, in twice the working precision."""
    total, rest = np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        p, lacks = _product(x, y)
        total, lost = _sum(total, p)
        rest += lacks + lost
    return _sum(total, rest)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` and ``b``, rounded once.

    Each row is taken by itself in one order of operations and in twice the working precision, so a pair's cosine doesn't depend on its place
    and parallel vectors tie.
    """
    (dot, dot_), (aa, aa_), (bb, bb_) = _dot(a, b), _dot(a, a), _dot(b, b)
    square, square_ = _product(aa, bb)
    square, square_ = _sum(square, square_ + aa * bb_ + aa_ * bb)
    root = np.sqrt(square)
    p, p_ = _product(root, root)
    root_ = ((square - p) - p_ + square_) / (2 * root)
    cosine = dot / root
    p, p_ = _product(cosine, root)
    return cosine + (((dot - p) - p_) + dot_ - cosine * root_) / root


def apart(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that a query's ``k`` best can come from: of equal vectors those of the smallest ids.

    A query leaves out rows of its own id, of which there may be several: of one id ``k`` rows are enough, of one vector 2 ``k``.
    """
    same = np.unique((vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))

    def place(new: np.ndarray) -> np.ndarray:
        """How many rows came before each one since the last new one."""
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    first = np.append(True, same[order][1:] != same[order][:-1])
    order = order[place(first | np.append(True, ids[order][1:] != ids[order][:-1])) < k]
    first = np.append(True, same[order][1:] != same[order][:-1])
    return np.sort(order[place(first) < 2 * k])


def search(block: Block, pivots: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the ids and cosines of the best rows of one stretch."""
    if not len(ids):
        return
    own = apart(ids, vectors, k)
    ids, vectors = ids[own], vectors[own]
    units = unit(vectors)
    files = InvertedFiles(permutations(units, pivots, block.prefixes.shape[1]), len(pivots))
    order = np.argsort(ids, kind="stable")
    rank_of = np.empty(len(ids), np.int64)
    rank_of[order] = np.arange(len(ids))
    take = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
    asked, found = unit(block.vectors), []
    for q in range(len(block.ids)):
        if take < len(ids):
            # distances are whole numbers: the id's rank breaks their ties
            distance = files.footrule(block.prefixes[q]) * len(ids) + rank_of
            some = np.argpartition(distance, take)[:take]
        else:
            some = np.arange(len(ids))
        some = some[ids[some] != block.ids[q]]
        near = units[some] @ asked[q]
        if len(some) > k:  # the best and all that rounding may have put behind them
            some = some[near >= np.partition(near, len(some) - k)[len(some) - k] - SLACK]
        found.append(some)
    sizes = np.array([len(f) for f in found])
    rows, of = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    exact = np.empty(len(rows))
    for at in range(0, len(rows), STRETCH):
        part = slice(at, at + STRETCH)
        exact[part] = cosines(vectors[rows[part]], block.vectors[of[part]])
    for q, end in enumerate(np.cumsum(sizes)):
        mine, score = rows[end - sizes[q] : end], exact[end - sizes[q] : end]
        best = _best(score, ids[mine], k)
        yield q, ids[mine[best]], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, stretch: int = STRETCH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query."""
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = usable(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull()), "embedding")
    asked = usable(queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull()), "embedding")
    found = spark.createDataFrame([], schema)
    for length, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("embedding")).count().collect()):
        same = rows.where(F.size("embedding") == length)
        drawn = same.orderBy(F.xxhash64("vec_id", F.lit("pivots")), "vec_id").limit(SAMPLE_ROWS).select("embedding").distinct().toArrow()
        sampled = unit(matrix(drawn.column(0).combine_chunks()))
        sampled = sampled[np.lexsort(sampled.T[::-1])]
        chosen = sampled[np.random.default_rng(3).permutation(len(sampled))[:pivots]]
        blocks = -(-n // block)
        for b in range(blocks):
            part = asked.where(F.size("embedding") == length)
            part = part if blocks == 1 else part.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
            held = part.orderBy("vec_id").toArrow()
            if not held.num_rows:
                continue
            q = matrix(held.column(1).combine_chunks())
            shared = spark.sparkContext.broadcast((Block(held.column(0).to_numpy(), q, permutations(unit(q), chosen, prefix)), chosen))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                block, pivots = shared.value
                n = len(block.ids)
                ids, scores = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
                for batch in batches:
                    for at in range(0, len(batch), stretch):
                        rows = batch.slice(at, stretch)
                        for q, i, s in search(block, pivots, rows.column(0).to_numpy(), matrix(rows.column(1)), k, share, least):
                            i, s = np.concatenate([ids[q], i]), np.concatenate([scores[q], s])
                            best = _best(s, i, k)
                            ids[q], scores[q] = i[best], s[best]
                sizes = [len(i) for i in ids]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, sizes)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=schema.names)

            found = found.union(map_arrow(same, run, schema))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))

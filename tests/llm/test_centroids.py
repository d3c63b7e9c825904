import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import centroids as cl


def lloyd(rows, k, dims, scale=256, rounds=5, seed=2):
    """Rows (vec_id, vector) by plain loops over whole numbers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    means = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(means)) for _, v in kept] if means else []

    for _ in range(rounds):
        of = [j for _, j in assigned()]
        for j in range(len(means)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                means[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assigned()
    inertia = {j: sum(d for d, c in last if c == j) for _, j in last}
    return sorted(((i is None, i or 0), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def found(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def some(seed, n, dims):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims) * rng.choice([0.01, 1.0, 30.0])]) for i in rng.permutation(n)]
    rows += [rows[0]] * 7 + [(rows[1][0], rows[2][1])] * 3  # repeated rows, and ids with several vectors
    rows += [(n + i, [0.5, -0.5] * (dims // 2)) for i in range(n // 3)]  # a third are copies
    nan, inf = float("nan"), float("inf")
    return rows + [(None, rows[3][1]), (n * 2, None), (n * 2 + 1, []), (n * 2 + 2, [1.0] * (dims - 1)), (n * 2 + 3, [nan] * dims), (n * 2 + 4, [None] + [1.0] * (dims - 1)), (n * 2 + 5, [inf] + [0.0] * (dims - 1)), (n * 2 + 6, [-0.0] * dims)]


@pytest.mark.parametrize(("k", "parts", "kind"), [(5, 1, "float"), (5, 7, "float"), (12, 3, "double"), (900, 3, "double"), (1, 2, "double")])
def test_against_loops(spark, k, parts, kind):
    dims = 8
    rows = some(k, 60, dims)
    if kind == "float":
        rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "'x' as Distance", "2 as hash", "3 as n").repartition(parts)
    assert found(cl.cluster(frame, k=k, dims=dims)) == lloyd(rows, k, dims)


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(100 + i, [1.5, 0.0]) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rounds in (0, 1, 5):
        assert found(cl.cluster(frame, k=9, dims=2, rounds=rounds)) == lloyd(rows, 9, 2, rounds=rounds)


def test_empty_and_no_vector_that_takes_part(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    out = cl.cluster(frame, dims=2)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cl.cluster(frame.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert cl.cluster(unnamed, dims=2).count() == 0  # no centroid to start from


def test_large_components():
    column = pa.array([[1e300, -1e300], [0.0, 3e5], [1e306, 1e308]], pa.list_(pa.float64()))
    at, x = cl.whole(column, 2)
    assert list(at) == [0, 1, 2] and x.tolist() == [[cl.LARGEST, -cl.LARGEST], [0, 256 * 300000], [cl.LARGEST] * 2]
    cluster, distance = cl.closest(x, np.array([[0, 0], [cl.LARGEST, cl.LARGEST]]))
    assert cluster.tolist() == [0, 0, 1] and distance.tolist() == [2 * cl.LARGEST**2, (256 * 300000) ** 2, 0]
    sliced = pa.array([None, [1.0, 2.0], [3.0, None], [-0.001, 4.0]], pa.list_(pa.float32())).slice(1)
    at, x = cl.whole(sliced, 2)
    assert list(at) == [0, 2] and x.tolist() == [[256, 512], [-1, 1024]]


def test_small_and_large_differences_agree():
    rng = np.random.default_rng(1)
    x, means = rng.integers(-3000, 3000, (500, 64)), rng.integers(-3000, 3000, (40, 64))
    for scale in (1, 100):
        cluster, distance = cl.closest(x * scale, means * scale)
        full = ((x[:, None] - means[None]) ** 2).sum(axis=2) * scale**2
        assert np.array_equal(distance, full.min(axis=1)) and np.array_equal(cluster, full.argmin(axis=1))

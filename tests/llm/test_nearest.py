import numpy as np

from tallyloom.llm import nearest as nn


def brute(rows, asked, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, v in good:
        if asked(i):
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in good if j != i and len(w) == len(v))
            out.setdefault(i, near[:k])
    return out


def test_edges_are_exact(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, None]), (250, []), (300, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.5]), (5, [1.0, 0.0, 0.0]), (350, [0.0, 2.0, 0.0]), (6, [float("inf"), 0.0]), (7, [3.0, 0.1]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank")
    got = {}
    for r in nn.nearest(frame, frame.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
        assert [f[2] for f in sorted(found)] == [i for _, i in want[q]]
    assert nn.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    found = nn.op3(spark, sf).collect()
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in found:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, want.values()))
    blocks = nn.nearest(*[spark.read.parquet(f"{sf}/embeddings.parquet")] * 2, block=700, k=2)
    assert blocks.count() == 2 * len(rows)


def test_footrule():
    rng = np.random.default_rng(0)
    prefixes = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = nn.InvertedFiles(prefixes, 12)
    query = rng.permutation(12)[:5]

    def rank(p, x):
        return list(p).index(x) if x in p else 5

    full = np.array([sum(abs(rank(p, x) - rank(query, x)) for x in range(12)) for p in prefixes])
    assert len(set(full - files.footrule(query))) == 1


def test_vectors_of_any_size(spark):
    rows = [(0, [1e200, 2e200]), (50, [3e-200, 1e-200]), (1, [2e-200, 4e-200]), (2, [1e300, 3e299]), (3, [5e-324, 0.0]), (4, [0.0, 0.0]), (5, [-1e308, -1e308])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as score", "1 as rank")
    found = nn.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    assert all(np.isfinite(r.score) and abs(r.score) <= 1 + 1e-12 for r in found)
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows if any(v)}
    for q in (0, 50):
        cosine = {i: unit[q] @ v / (np.linalg.norm(unit[q]) * np.linalg.norm(v)) for i, v in unit.items() if i != q}
        want = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == want and np.allclose([r.score for r in own], [cosine[i] for i in want], atol=1e-12)


def test_ties_do_not_depend_on_places():
    """Copies and parallel vectors at any place of blocks of any size: 400 cases."""
    rng = np.random.default_rng(8)
    for case in range(400):
        n, d = int(rng.integers(12, 160)), int(rng.choice([2, 7, 64]))
        vectors = rng.normal(size=(n, d))
        vectors[rng.integers(n, size=n // 3)] = vectors[0] if case % 2 else vectors[1]
        scaled = rng.integers(n, size=n // 4)
        vectors[scaled] *= rng.choice([2.0, 0.25, 8.0], size=(len(scaled), 1))
        ids = rng.permutation(3 * n)[:n] if case % 3 else rng.integers(n, size=n)
        asked = vectors[:3] + (rng.normal(size=(3, d)) * 0.01 if case % 5 else 0)
        vectors, scale = vectors.astype(np.float32).astype(float), np.ldexp(1.0, -3)
        pivots = nn.unit(vectors[:8])
        block = nn.Block(ids[:3], asked, nn.permutations(nn.unit(asked), pivots, 4))
        k = int(rng.integers(1, 8))
        for q, found, scores in nn.search(block, pivots, ids, vectors * scale, k, 1.0, 64):
            exact = nn.cosines(vectors, np.repeat(asked[q : q + 1], n, axis=0))
            want = sorted((-exact[i], ids[i]) for i in range(n) if ids[i] != ids[q])[:k]
            assert list(zip(-scores, found, strict=True)) == want
        plain = nn.unit(vectors) @ nn.unit(asked).T
        assert np.allclose(plain[:, 0], nn.cosines(vectors, np.repeat(asked[:1], n, axis=0)), atol=1e-14)


def test_cosines_are_rounded_once():
    from fractions import Fraction
    from math import isqrt

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(60, 9)), rng.normal(size=(60, 9))
    got = nn.cosines(a, b)
    for x, y, c in zip(a, b, got, strict=True):
        x, y = [Fraction(float(v)) for v in x], [Fraction(float(v)) for v in y]
        dot = sum(p * q for p, q in zip(x, y, strict=True))
        square = dot * dot / (sum(p * p for p in x) * sum(q * q for q in y))
        root = Fraction(isqrt(int(square * (1 << 300))), 1 << 150)
        assert c == float(root if dot > 0 else -root)
    assert (nn.cosines(a * 3.7, b) == got).mean() > 0.5 and np.array_equal(nn.cosines(a * 4, b / 8), got)


def test_ties_over_partitions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 16))
    rows = [(int(i), [float(x) for x in base[int(rng.integers(4))] * float(rng.choice([1.0, 2.0, 3.0]))]) for i in rng.permutation(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts, stretch in ((1, 8192), (7, 16), (13, 3)):
        found = nn.nearest(frame.repartition(parts), frame.where("vec_id % 50 = 0"), stretch=stretch).collect()
        vectors = dict(rows)
        for q in range(0, 400, 50):
            own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
            same = [i for i in sorted(vectors) if i != q and np.allclose(np.array(vectors[i]) / np.linalg.norm(vectors[i]), np.array(vectors[q]) / np.linalg.norm(vectors[q]))][:5]
            assert [r.vec_id for r in own] == same

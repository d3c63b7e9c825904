import math
from collections import defaultdict

from tallyloom.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Reshare what is above a limit by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, total = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s] + 1e-9}
        for s in full or open_:
            target[s] = float(most * sizes[s]) if full else level * weight[s]
        open_ -= full or set(open_)
    return target


def check(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = filled(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert all(r.source_size == sizes[s] for r in rows if r.source == s)
    return taken, target


def test_exact_budgets(spark):
    docs = spark.createDataFrame(
        [(i, ["b", "a", None, "é", "Z", "tiny"][i % 6 if i % 7 else 0], "w " * (i % 23) + " \tx" * (i % 3)) for i in range(3000) if i % 6 != 5 or i < 30], "doc_id long, source string, text string"
    ).selectExpr("*", "1 as size", "2 as other")
    got = mixing.mix(docs, bucket_rows=50)
    assert got.columns == ["doc_id", "source", "text", "other", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == docs.count()
    taken, target = check(rows)
    assert all(taken[s] == math.floor(target[s]) for s in taken)
    again = mixing.mix(docs.repartition(7), bucket_rows=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    rows = [(1, "a", "x " * 100), (1, "a", "x " * 100), (1, "a", "x " * 100), (None, "a", None), (2, "b", ""), (3, "b", None), (4, None, "word"), (5, "c", "y " * 100_000)]
    check(mixing.mix(spark.createDataFrame(rows, schema)).collect())
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_native_plan(spark):
    plan = mixing.op8(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

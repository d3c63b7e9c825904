import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import bloom, gates


def grams(text, n):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_overlaps_by_filters_and_without(spark):
    rnd = random.Random(2)
    shared = " ".join(rnd.choice("abcdefgh") for _ in range(40))
    text = lambda: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40)))
    rows = [(i, text() + " " + (shared[: rnd.randint(0, 79)] if rnd.random() < 0.6 else "")) for i in range(120)] + [(200, None), (201, ""), (5, shared), (5, shared), *((300 + i, "Same Passage " * 9) for i in range(60))]
    held = [(text() + " " + shared[rnd.randint(0, 40) :],) for _ in range(10)] + [(None,), ("same passage same passage same passage",)]
    docs, holdout = spark.createDataFrame(rows, "id long, text string").repartition(5), spark.createDataFrame(held, "text string")
    known = set().union(*(grams(t, 4) for t, in held))
    want = {}
    for i, t in rows:
        g = grams(t, 4)
        a, b = want.get(i, (0, 0))
        want[i] = (a + len(g), b + len(g & known))
    want = sorted((i, a, b) for i, (a, b) in want.items() if b and b >= 0.2 * a)
    for bits in (bloom.MAX_BITS, 1):
        got = sorted(tuple(r) for r in gates.overlaps(docs, holdout, "id", n=4, max_bits=bits).collect())
        assert got == want
    assert gates.overlaps(docs.limit(0), holdout, "id").count() == 0 and gates.overlaps(docs, holdout.limit(0), "id").count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bits = bloom.bits_for(20_000)
    filled = bloom.build(hashes.repartition(3), "h", bits)
    assert len(filled) * 8 == bits
    own = np.array([r.h for r in hashes.collect()])
    other = np.array([r.h for r in spark.range(20_000).select(F.xxhash64(F.col("id") + 1_000_000).alias("h")).collect()])
    assert bloom.holds(filled, own).all() and bloom.holds(filled, other).mean() < 0.02
    lists = spark.createDataFrame([([1, 2],), ([],), ([int(own[0]), 3, int(own[1])],)], "a array<long>")
    got = [r.k for r in lists.select(bloom.suspected(spark, filled, F.col("a")).alias("k")).collect()]
    assert got[1] == [] and [int(own[0]), int(own[1])] == [x for x in got[2] if x in (int(own[0]), int(own[1]))]

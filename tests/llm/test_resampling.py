import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import resampling as rs
from tallyloom.llm import textscan as ts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, max_n=1, percent=10, least=20, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for x in texts for f in runs(x, max_n)[1]) for texts in ([d[1] for d in docs], target))
    whole, aim = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, fs = runs(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in map(bucket, fs))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words), len(fs), weight, score))
    able = sorted((o for o in out if o[1] >= least and o[0] is not None), key=lambda o: (-o[4], o[0], o[2], o[1]))
    place = Counter()
    ranks = {}
    for n, o in enumerate(able[: percent * len(able) // 100], 1):
        ranks[o, place[o]] = n
        place[o] += 1
    met, rows = Counter(), []
    for o in out:
        rows.append((o[0], o[2], o[3], o[4], ranks.get((o, met[o]))))
        met[o] += 1
    return sorted(rows, key=repr)


def texts(seed, n):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wort", "mot", "é", "x1", "数据") for b in range(30)] + ["y" * 100, "z" * 48, "z" * 49]
    text = lambda most: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, most)))
    docs = [(i * 7 - 100, text(60)) for i in range(n)]
    hot = text(60) + " a" * 30
    docs += [(55555, hot)] * (n // 2) + [(i + 10_000, hot) for i in range(n // 4)] + [(1, None), (2, ""), (None, hot), (None, None), (3, "... !!"), (4, "q" * 200_000 + " w" * 100_000)]
    return docs, [text(30) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"max_n": 3, "buckets": 97}), (3, {"percent": 55, "least_words": 0}), (4, {"percent": 100, "least_words": 5}), (5, {"percent": 0})])
def test_against_loops(spark, seed, options):
    docs, target = texts(seed, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    hashed = {k: options[k] for k in ("buckets", "max_n") if k in options}
    drawing = {k: options[k] for k in ("percent", "least_words") if k in options}
    gain = rs.gains(rs.bucket_counts(frame, **hashed), rs.bucket_counts(bench, **hashed))
    scored = rs.weigh(frame, gain, max_n=options.get("max_n", 1)).withColumn("score", rs.score()).drop("text")
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rs.draw(scored, **drawing).collect()), key=repr)
    want = brute(docs, target, least=options.get("least_words", 20), **{k: v for k, v in options.items() if k != "least_words"})
    assert got == want
    drawn = rs.resample(frame, bench, **options).collect()
    assert sorted((r.doc_id, r["rank"]) for r in drawn) == sorted((w[0], w[4]) for w in want if w[4])
    by_id = dict(docs)
    assert all(r.text == by_id[r.doc_id] for r in drawn)


def test_crc_of_words_of_any_length():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aé数z9") for _ in range(rnd.choice([1, 2, 5, 17, 60, 5000]))) for _ in range(300)]
    chunk = next(ts.chunks(pa.array([" ".join(words)]), size=1 << 30))
    spans = ts.words(chunk, ts.ALNUM)
    crc = rs.crc32(chunk.data, spans.starts, spans.ends)
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in words]
    after = rs.crc32(chunk.data, spans.starts, spans.ends, np.full(len(words), zlib.crc32(b"before "), np.uint32))
    assert after.tolist() == [zlib.crc32(b"before " + w.encode()) for w in words]
    none = np.zeros(0, np.int64)
    assert len(rs.crc32(chunk.data, none, none)) == 0


@pytest.mark.parametrize("seed", range(4))
def test_last_key(spark, seed):
    """Scores of both signs and any size, many ties, ids at both ends of the long range."""
    rnd = random.Random(seed)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    score = [lambda: rnd.randint(-3, 3), lambda: rnd.choice(ends), lambda: rnd.randint(-(10**6), 10**6), lambda: 7][seed]
    rows = [(score(), rnd.choice(ends) if rnd.random() < 0.3 else rnd.randint(-(1 << 62), 1 << 62)) for _ in range(200)]
    keys = spark.createDataFrame(rows, "score long, id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert rs.last_key(keys, 0) is None
    for k in (1, 2, 20, 99, 150, 200):
        s, i = rs.last_key(keys, k)
        upto = [r for r in order if r[0] > s or (r[0] == s and r[1] <= i)]
        assert upto[:k] == order[:k] and all(r == order[k - 1] for r in upto[k:])


def test_edges(spark, tmp_path):
    docs, target = texts(9, 30)
    names = ["N_Words", "n_FEATURES", "Weight", "SCORE", "Rank", "_text", "_made", "_at", "_row", "digit", "id"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = rs.resample(frame, bench, percent=50)
    assert out.columns == ["doc_id", "text", *names[5:], "n_words", "n_features", "weight", "score", "rank"]
    out.write.parquet(f"file://{tmp_path}/out")
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert rows and all(r[c] == i for r in rows for i, c in enumerate(names) if i >= 5)
    assert rs.resample(frame.limit(0), bench).count() == 0
    assert rs.resample(frame, bench.limit(0), percent=50).count() == len(rows)
    plain = sorted((r["rank"] for r in rows))
    assert plain == list(range(1, len(rows) + 1))


def test_narrow_scan(spark):
    plan = rs.op12(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

import random
import re
from collections import defaultdict

import pytest

from tallyloom.llm import near_dedup as nd

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent=80):
    sets = {d: shingles(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    common = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def by_id(rows, n, percent=80):
    """Brute force over (id, text) rows where rows of one id are one document: its links are those of all its texts."""
    texts = brute(list(enumerate(t for _, t in rows)), n, percent)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (d, _) in enumerate(rows):
        a, b = find((0, d)), find((1, texts[k][1]))
        root[max(a, b)] = min(a, b)
    return sorted((d, texts[k][0], find((0, d))[1], find((0, d))[1] == d) for k, (d, _) in enumerate(rows))


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (2, a + " a30"), (3, b.upper()), (3, None), (4, c), (4, c), (5, ""), (6, "b x y"), (5, c + " more"), (7, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.group(frame, shingle=2).collect()]
    assert sorted(found) == by_id(rows, 2)
    kept = sorted((r.doc_id, r.text) for r in nd.dedup(frame, shingle=2).collect() if r.text)
    # of each group of texts one row stays, so no text is lost
    assert kept == [(1, a), (2, b), (4, c), (6, "b x y")]


def test_random_ids(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    rows = []
    for _ in range(150):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(40)] = rng.choice(words)
        rows.append((rng.randrange(110), " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.group(frame, shingle=2).collect()]
    assert sorted(found) == by_id(rows, 2)
    groups = brute(list(enumerate(t for _, t in rows)), 2)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[groups[k][1]] = min(least.get(groups[k][1], d), d)
    kept = [(r.doc_id, r.text) for r in nd.dedup(frame, shingle=2).collect()]
    place = {row: k for k, row in enumerate(rows)}
    assert sorted((groups[place[r]][1], r[0]) for r in kept) == sorted(least.items())


def same(rows, want):
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = nd.op2(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(docs)
    same(rows, brute(docs, 2))


def test_drifting_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs, text = [], [rng.choice(words) for _ in range(60)]
    for i in range(120):  # a chain: neighbours alike, ends not
        docs.append((i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(60)] = rng.choice(words)
    base = [rng.choice(words) for _ in range(60)]
    for i in range(120, 320):  # a cloud round one text, partly below the limit
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(60)] = rng.choice(words)
        docs.append((i, " ".join(t)))
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same(nd.group(frame, shingle=2).collect(), brute(docs, 2))
    same(nd.group(frame).collect(), brute(docs, 5))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "One\ttwo"), (8, "x y " * 40_000), (9, "x y " * 39_000), (10, "é è")]
    extra = "struct(1 as a) as size"
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", extra, "'k' as id")
    same(nd.group(frame, shingle=2).collect(), brute(docs, 2))
    kept = nd.dedup(frame.union(frame), shingle=2)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 10]
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in nd.group(nameless).collect()) == [("1", "1", True), ("None", "1", True), ("None", "1", True)]
    assert nd.group(frame.limit(0)).count() == 0

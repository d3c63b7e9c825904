import hashlib
import re

from tallyloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, bench, n=13):
    windows = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        k = min(n, len(w))
        for j in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    for d, t in docs:
        w, hit, items = WORD.findall(lower(t)), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    items |= found
        yield d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in dc.op1(spark, sf).collect()) == sorted(brute(docs, bench))


def test_edges_and_shards(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = [(1, passage), (2, "Short Item"), (3, ""), (4, None), (1, passage), (10, f"x {passage}"), (11, "ÄÖ ü")]
    docs = [(1, None), (2, ""), (3, "!!"), (4, f"a {passage.upper()}!"), (5, "a short-item here"), (6, "x " * 50_000 + passage), (7, "shortitem"), (7, "äö ü ÄÖ ü"), (8, " ".join(passage.split()[:12]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as n_hit")
    for shard_bytes in (1 << 20, 60):
        got = dc.find_contamination(d, b, shard_bytes=shard_bytes).selectExpr("doc_id", "n_words", "n_hit", "size(items)", "sha2(array_join(items, ','), 256)", "n_hit > 0 and 20 * n_hit >= n_words")
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, bench))
    kept = dc.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 8]
    cut = {(r.doc_id, r.text) for r in dc.decontaminate(d, b, mode="span").collect()}
    assert (4, "a !") in cut and (5, "a  here") in cut and (7, "äö ü ") in cut and (1, None) in cut
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(d, empty).count() == len(docs)
    assert dc.find_contamination(d.limit(0), b).count() == 0

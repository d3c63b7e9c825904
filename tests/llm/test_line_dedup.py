import hashlib
import re

import pytest

from tallyloom.llm import line_dedup as ld


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def brute(docs, min_docs, min_chars):
    count = {}
    for _, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


DOCS = [(i, f" Shared {'LINE' if i % 2 else 'line'}\t\nown {i}\n\n x \nown {i}") for i in range(12)] + [
    (100, None), (101, ""), (102, "\n\n"), (103, "shared line"), (103, "shared line"), (104, "é\n" * 3 + "É"), (105, "z" * 300_000 + "\nshared line\n" + "z" * 10), (106, " x "), (None, "é"),
]


@pytest.mark.parametrize(("min_docs", "min_chars", "broadcast_keys"), [(10, 1, 100), (2, 1, 100), (2, 3, 100), (2, 1, 0), (10, 1, 0), (2, 0, 100)])
def test_matches_brute_force(spark, min_docs, min_chars, broadcast_keys):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "'other' as n_lines", "1 as extra").repartition(3)
    got = ld.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, broadcast_keys=broadcast_keys)
    assert got.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str)
    assert rows == sorted(brute(DOCS, min_docs, min_chars), key=str)


def test_query_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(docs, 10, 1))
    assert sorted(tuple(r) for r in ld.op9(spark, sf).collect()) == want
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("min_docs", "min_chars", "block_lines", "stretch"), [(2, 1, 1 << 20, 1 << 20), (10, 1, 4, 200), (2, 0, 7, 1), (3, 1, 1, 500)])
def test_filters_over_the_executors(spark, monkeypatch, min_docs, min_chars, block_lines, stretch):
    monkeypatch.setattr(ld, "STRETCH_BYTES", stretch)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("doc_id", "text", "'other' as N_LINES", "doc_id as Stretch", "text as key", "1 as hash").repartition(3)
    got = ld.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, max_bits=512, block_lines=block_lines)
    assert got.columns == ["doc_id", "text", "Stretch", "key", "hash", "n_lines", "n_dropped"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows), key=str) == sorted(brute(DOCS, min_docs, min_chars), key=str)
    assert all(r.Stretch == r.doc_id and (r.text is None) == (r.key is None) for r in rows)


def test_spread_rows_equal_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted(tuple(r) for r in df.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)").collect())
    assert rows(ld.dedup_lines(docs, max_bits=512, block_lines=500)) == rows(ld.dedup_lines(docs))
    assert ld.dedup_lines(docs.limit(0), max_bits=0).count() == 0 and ld.dedup_lines(docs.limit(0), keep="first").count() == 0


def test_only_suspects_come_back(spark):
    """At 16 bits a line few lines that occur once are suspected, however many blocks the filters lie in."""
    docs = spark.createDataFrame([(i, "\n".join(["shared", *(f"line {i} {k}" for k in range(50))])) for i in range(100)], "doc_id long, text string")
    keyed = ld._stretched(docs, "text", "row", "stretch")
    hashes = keyed.select("text", "stretch").mapInArrow(ld._send(1, 5), ld._HASHES)
    assert hashes.select("block").distinct().count() == 5
    answers = hashes.groupBy("block").applyInArrow(ld._answer(ld.filter_bits(1000)), ld._ANSWERS).collect()
    assert len({r.stretch for r in answers}) == keyed.select("stretch").distinct().count() and len({r["hash"] for r in answers}) < 50


@pytest.mark.parametrize(("min_docs", "max_bits"), [(2, 1 << 20), (10, 1 << 20), (2, 512)])
def test_first_occurrence_stays(spark, min_docs, max_bits):
    docs = spark.createDataFrame([(i, *d) for i, d in enumerate(DOCS)], "place int, doc_id long, text string").repartition(1).sortWithinPartitions("place")
    count, met = {}, set()
    for _, t in DOCS:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = {}
    for i, (_, t) in enumerate(DOCS):
        kept = []
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) < 1 or count[k] < min_docs or k not in met:
                kept.append(x)
            met.add(k)
        want[i] = "\n".join(kept)
    got = ld.dedup_lines(docs, min_docs=min_docs, max_bits=max_bits, keep="first")
    assert {r.place: r.text or "" for r in got.collect()} == want
    with pytest.raises(ValueError, match="none or first"):
        ld.dedup_lines(docs, keep="last")

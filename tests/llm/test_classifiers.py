import math
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import quality, toxicity
from tallyloom.llm.frames import table
from tallyloom.llm.labelled import sample

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    kept = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return np.mean([a == b for a, b in kept])


def test_quality(spark):
    assert held_out(spark, quality.op4, "quality") > 0.95


def test_toxicity(spark):
    assert held_out(spark, toxicity.op5, "toxic") > 0.9


DOCS = [(1, None), (2, ""), (3, "you idiot. Nice day today."), (3, "you idiot. Nice day today."), (4, "word " * 40_000), (None, "plain"), *((i, "fool text. fine here" if i % 2 else f"good text {i}. fine here") for i in range(10, 90))]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as label", "2 as toxicity", "3 as quality_score")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10, 90)] + [(10, None, None), (None, 1, 1), (10, 0, 0)], "doc_id long, toxic int, quality int")
    model = module.train(docs, labels)
    name = "toxicity" if module is toxicity else "quality_score"
    scores = module.score(docs, model).collect()
    assert len(scores) == len(DOCS) and all(0 <= r[name] <= 1 for r in scores)
    assert module.score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert module.score(docs, module.train(docs, few)).count() == len(DOCS)
    kept = toxicity.reject(docs, model) if module is toxicity else quality.keep_good(docs, model)
    assert kept.columns == docs.columns


def test_offending_sentences(spark):
    docs = spark.createDataFrame([r for r in DOCS if r[0] is not None], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 90)], "doc_id long, toxic int")
    rows = toxicity.locate(docs, toxicity.train(docs, labels)).where("doc_id >= 10").collect()
    for r in rows:
        found = [r.text.encode()[s["from"] : s["to"]].decode() for s in r.offending]
        assert found == (["fool text"] if r.doc_id % 2 else [])


@pytest.mark.parametrize(("sf", "least_recall"), [("sf0.001", 0.9), ("sf0.01", 0.6)])
def test_toxicity_of_small_tables(spark, sf, least_recall):
    """Held-out toxic documents are found, and clean ones left alone, with tens of labels as well."""
    where = f"/root/testdata/{sf}"
    truth = {r.doc_id: r.toxic for r in table(spark, where, "labels").collect()}
    rows = toxicity.op5(spark, where).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    toxic = sum(t for _, t in held)
    assert sum(p and t for p, t in held) >= least_recall * toxic
    assert sum(p and not t for p, t in held) <= 0.05 * (len(held) - toxic)
    assert sum(r.predicted for r in rows) < 0.2 * len(rows)


def test_cut_lies_between_scores():
    cut = lambda raw, labels: toxicity.best_cut(np.array(raw, float), np.array(labels))
    # ties stand on one side, and a cut that calls mostly clean documents toxic isn't one
    assert cut([3, -1, -1, -1, -1], [0, 1, 0, 0, 0]) > 3
    assert 1 < cut([2, 2, 2, 1, 0], [1, 1, 0, 0, 0]) < 2
    assert cut([5, 5, 5], [1, 0, 1]) > 5
    assert -1 < cut([4, -1, -1], [1, 0, 0]) < 4


def test_ties_and_no_evidence(spark):
    rows = [(i, f"text {i} stays") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(40)], "doc_id long, toxic int")
    scores = {r.toxicity for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    scores = {r.toxicity for r in toxicity.score(docs, toxicity.train(docs, labels.selectExpr("doc_id", "1 as toxic"))).collect()}
    assert len(scores) == 1 and scores.pop() >= 0.5


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def low(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def bucket(word, add=None):
    h = toxicity.ts.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    return int((h if add is None else toxicity.ts.mix(h + np.uint64(add)))[0])


def test_toxicity_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))

    def weights(w):
        yield float(model.weights[bucket(w) % toxicity.BUCKETS])
        for n in toxicity.PREFIXES:
            if len(w) >= n:
                yield float(model.weights[bucket(w[:n], n) % toxicity.BUCKETS])

    def plain(text):
        clean = 0.0  # log of the probability that no sentence offends
        for sentence in re.split(rb"[\n!.?]", low(text)):
            own = [x for w in WORD.findall(sentence) for x in weights(w) if x]
            if own:
                clean -= math.log1p(math.exp(model.bias + sum(own)))
        a = min(max(-clean, 1e-12), 500)
        return 1 / (1 + math.exp(-max(-40, min(40, math.log(-math.expm1(-a)) + a - model.cut))))

    got = {r.doc_id: r.score for r in toxicity.op5(spark, sf).collect()}
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-4 for d in got)


def test_quality_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))

    def plain(text):
        data = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
        size, n = max(len(data), 1), max(len(words), 1)
        shares = [0] * 129
        for c in data:
            shares[min(c, 128)] += 1
        breaks = data.count(b"\n")
        dense = [math.log1p(1000 * x / size) for x in shares] + [
            math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / n, 10 * sum(65 <= c <= 90 for c in data) / size,
            10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, math.log1p(breaks), 10 * breaks / n,
        ]
        raw = sum(max(-8, min(8, (x - c) / s)) * w for x, c, s, w in zip(dense, model.centre, model.spread, model.weights, strict=True))
        buckets = {bucket(w) % quality.WORD_BUCKETS for w in WORD.findall(low(text))}
        raw += sum(model.words[b] for b in buckets) / math.sqrt(max(len(buckets), 1))
        return 1 / (1 + math.exp(-max(-40, min(40, raw - model.cut + math.log(quality.CUT / (1 - quality.CUT))))))

    rows = quality.op4(spark, sf).collect()
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(7, "another"), (None, "x"), (8, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 2 + [(5, 1), (None, 1)], "doc_id long, toxic int")
    few = [sorted((r.draw, r.id, r.label, r.text) for r in sample(docs.repartition(n), labels.repartition(n), "toxic", bound=50, longest=1000).collect()) for n in (1, 5)]
    assert few[0] == few[1] and len(few[0]) in (49, 50)
    everything = sample(docs, labels, "toxic").collect()
    assert len({r.id for r in everything}) == len(everything) and {r.id for r in everything} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5}
    assert {r.label for r in everything if r.id == 5} <= {1}

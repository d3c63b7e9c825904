import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import language_id as li
from tallyloom.llm.token_counts import default_model, model_bytes

VOCABULARY = li.vocabulary_of(model_bytes(default_model()))


def pieces_in(word):
    """(from, to) of each piece in a word, with its id."""
    ids = {(i, i + 1): word[i] for i in range(len(word))}
    for n, (lookup, numbers) in VOCABULARY.by_length.items():
        for i in range(len(word) - n + 1):
            k = lookup.find(li.ts.span_hashes(np.frombuffer(word, np.uint8), np.array([i]), np.array([i + n])))[0]
            if k >= 0:
                ids[i, i + n] = int(numbers[k])
    return ids


def brute(word, p):
    """Sum over all segmentations and expected counts, by enumeration."""
    ids = pieces_in(word)
    total, counts = 0.0, {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        marks = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        path = [ids.get(x) for x in itertools.pairwise(marks)]
        if None not in path:
            q = np.prod([p[k, 0] for k in path])
            total += q
            for k in path:
                counts[k] = counts.get(k, 0) + q
    return total, {k: v / total for k, v in counts.items()}


def exact(word, p, column):
    """The same by a programme over prefixes and suffixes in exact fractions, for words of any length."""
    ids = pieces_in(word)
    q = {k: Fraction(float(p[k, column])) for k in set(ids.values())}
    fore, back = [Fraction(0)] * (len(word) + 1), [Fraction(0)] * (len(word) + 1)
    fore[0] = back[-1] = Fraction(1)
    for (i, j), k in sorted(ids.items(), key=lambda x: x[0][1]):
        fore[j] += fore[i] * q[k]
    for (i, j), k in sorted(ids.items(), reverse=True):
        back[i] += back[j] * q[k]
    counts = {}
    for (i, j), k in ids.items():
        counts[k] = counts.get(k, 0) + float(fore[i] * q[k] * back[j] / fore[-1])
    log = math.log(fore[-1].numerator) - math.log(fore[-1].denominator)
    return log, counts


def lattice_of(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    [(_, lattice)] = li._lattices(VOCABULARY, data, ends - [len(w) for w in words], ends, 2)
    return lattice


def test_forward_and_expected_counts():
    p = np.random.default_rng(1).random((VOCABULARY.size + 1, 2))
    p[-1] = 0
    words = sorted([b"the", b"an", "für".encode(), b"statement", b"x", b"inga"], key=len)
    lattice = lattice_of(words)
    totals = np.exp(lattice.logs(p))
    expected = lattice.expected(p, np.full((len(words), 2), 2.0))
    want = np.zeros(len(p))
    for w, total in zip(words, totals, strict=True):
        q, counts = brute(b" " + w, p)
        assert np.isclose(total[0], q)
        for k, v in counts.items():
            want[k] += 2 * v
    assert np.allclose(expected[:, 0], want)


def test_long_words_are_not_cut():
    rng = np.random.default_rng(2)
    p = rng.random((VOCABULARY.size + 1, 2)) * 1e-6
    p[:, 1] *= 10.0 ** -rng.integers(0, 20, len(p))  # one column far below the other
    p[-1] = 0
    words = sorted(["は日本語の文章です。これは長い".encode(), "ö".encode(), b"statement", ("数据处理" * 6).encode(), b"internationalisation" * 6], key=len)
    assert len(words[2]) > 40
    lattice = lattice_of(words)
    logs = lattice.logs(p)
    weights = np.arange(1.0, len(words) + 1)[:, None] * [1, 3]
    expected, want = lattice.expected(p, weights), np.zeros((len(p), 2))
    for w, log, weight in zip(words, logs, weights, strict=True):
        for c in (0, 1):
            right, counts = exact(b" " + w, p, c)
            assert np.isclose(log[c], right, rtol=1e-12)
            for k, v in counts.items():
                want[k, c] += weight[c] * v
    assert np.allclose(expected, want, rtol=1e-9, atol=1e-12)
    data = np.frombuffer("是".encode() * 30, np.uint8)
    _, number, starts, ends = li._words(li.ts.Chunk(0, data, np.array([0, len(data)])))
    assert len(number) == 1 and ends[0] - starts[0] == 90


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = li.op7(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held if truth[r.doc_id]]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "der das ist", None), (5, "", "de"), (6, "123 !?", "en"), (7, "— 🙂", None), (8, "hund" * 20_000, None), (9, "ü", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred")
    model = li.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "de", "und", "und", "und"]
    assert got[8].lang_pred == "de" and got[9].lang_pred in ("de", "en") and got[3].lang_score == 0
    assert li.identify(docs.limit(0), model).count() == 0
    nothing = li.train(docs.limit(0))
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}


def test_distinct_words_add_up():
    texts = [b"the cat the dog", b"a cat and the end", b""]
    known, want = li.Distinct(1), {}
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        chunk = li.ts.Chunk(0, data, np.array([0, len(data)]))
        _, number, starts, ends = li._words(chunk)
        known.add(data, starts, ends, np.bincount(number, minlength=len(starts))[:, None].astype(float))
        for w in t.split():
            want[w] = want.get(w, 0) + 1
    got = {known.data[a:b].tobytes(): v[0] for a, b, v in zip(known.starts, known.ends, known.values, strict=True)}
    assert got == want
    assert (known.find(known.hashes) == np.arange(len(known))).all() and (known.find(np.array([5], np.uint64)) == -1).all()


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = li.train(docs.where(li.remainder("doc_id", 4) != 2))
    known = {}

    def word(w):
        if w not in known:
            ids = pieces_in(b" " + w)
            fore = np.zeros((len(w) + 2, len(model.languages)))
            fore[0] = 1
            for (i, j), k in sorted(ids.items(), key=lambda x: x[0][1]):
                fore[j] += fore[i] * model.pieces[k]
            known[w] = np.log(fore[-1])
        return known[w]

    got = {r.doc_id: r for r in li.op7(spark, sf).collect()}
    for r in docs.collect():
        low = (r.text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        logs = model.prior + sum((word(w) for w in re.findall(rb"[a-z\x80-\xff]+", low)), np.zeros(len(model.languages)))
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        assert got[r.doc_id].lang_pred == model.languages[int(logs.argmax())]
        assert abs(got[r.doc_id].score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6

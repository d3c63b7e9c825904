import math
import re
import zlib
from collections import Counter

import numpy as np

from tallyloom.llm import language_model as lm
from tallyloom.llm.frames import remainder

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(docs, held):
    count = Counter(t for d, x in docs if not held(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    for d, x in docs:
        ts = tokens(x)
        yield d, held(d), len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)


def same(rows, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want])
    assert all(r[6] <= 0 and math.isfinite(r[6]) for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op6(spark, sf).collect()
    same(rows, list(base(docs, lambda d: zlib.crc32(str(d).encode()) % 5 == 1)))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "The the\tTHE cat"), (3, "The the\tTHE cat"), (None, "unseen words"), (4, "x " * 50_000), (6, "dog")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False
    same(lm.score(frame, remainder("doc_id", 5) != 1).collect(), list(base(docs, held)))
    assert lm.score(frame.limit(0), remainder("doc_id", 5) != 1).count() == 0
    none = lm.score(frame, remainder("doc_id", 5) < 0).collect()
    assert {r.train_tokens for r in none} == {0} and {r.n_known for r in none} == {0}


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(lm.CLASSES, 50)).astype(np.float32)
    want = np.exp(z) / np.exp(z).sum(axis=0)
    got = lm._softmax(z.copy())
    assert np.allclose(got, want, atol=1e-5) and np.allclose(got.sum(axis=0), 1, atol=1e-5)


def test_every_known_token_is_a_leaf():
    rng = np.random.default_rng(1)
    kinds, mass = np.zeros(lm.BANDS, np.int64), np.zeros(lm.BANDS + 1)
    kinds[[0, 1, 2, 5, 9]], mass[[0, 1, 2, 5, 9]] = [37, 16, 5, 4, 1], [37, 20, 9, 30, 25]
    tree = lm.Tree(kinds, mass)
    numbers = np.arange(64)  # 0 is unknown
    paths = tree.paths(numbers, np.zeros(64, bool))
    model = lm.Model(5000)
    model.weights[:] = rng.normal(size=model.weights.shape)
    for context in (lm.contexts(*np.array([[3], [9], [0]])), lm.contexts(*np.array([[60], [1], [5]]))):
        assert np.isclose(np.sum(10 ** model.logs(paths, numbers, context.repeat(64, axis=1))), 1, atol=1e-4)


def test_context_raises_a_single_rare_token(spark):
    # 400 pairs of words; each first word is followed by its own second one, whose count is that of 799 others
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 400, 50))) for i in range(4000)]
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), remainder("doc_id", 5) != 1).collect()
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    # half of the tokens are certain, the other half one of 400: 1.3 on average; 2.9 without contexts
    assert sum(r.base_score for r in held) / n < -2.8
    assert sum(r.score for r in held) / n > -1.7


def test_slots_and_parts_follow_the_corpus():
    bits = [lm.Model(n).bits for n in (0, 1 << 14, 1 << 18, 1 << 20)]
    assert bits == [10, 13, 17, 19]
    stats = lambda n: lm.Statistics(n, n, -(-n // lm.PART_TOKENS), np.zeros((1, lm.BANDS), np.int64), lm.Tree(np.eye(lm.BANDS, dtype=np.int64)[0] * n, np.zeros(lm.BANDS + 1)))
    one, two = np.random.default_rng(3).integers(1, 1 << 22, (2, 1 << 16))
    assert [len(np.unique(lm._place(stats(n), 0, one, two))) for n in (lm.PART_TOKENS, 16 * lm.PART_TOKENS, 64 * lm.PART_TOKENS)] == [1, 16, 64]


def plainly(docs, trained):
    """Scores by the model as its docstring says it, in plain loops over numbers and dictionaries (for one part)."""
    texts = [tokens(t) for _, t in docs]
    word_hash = lambda w: int(lm.END) if w is None else int(lm.ts.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    count = Counter(word_hash(w) for ws, d in zip(texts, docs, strict=True) if trained(d[0]) for w in ws)
    # numbers by band, frequent bands first, and by hash within a band
    band = {h: max(k for k, e in enumerate(lm.EDGES) if e <= n) for h, n in count.items()}
    order = sorted(count, key=lambda h: (-band[h], h))
    number = {h: i + 1 for i, h in enumerate(order)}
    kinds, mass = np.zeros(lm.BANDS, np.int64), np.zeros(lm.BANDS + 1)
    for h, n in count.items():
        kinds[band[h]] += 1
        mass[max([k for k, e in enumerate(lm.EDGES) if e <= n - 1], default=-1) + 1] += n
    tree = lm.Tree(kinds, mass)
    bits = (max(lm.FEATURES, -(-sum(count.values()) // lm.TOKENS_PER_SLOT)) - 1).bit_length()

    def path(n, below):
        p = tree.paths(np.array([n]), np.array([below]))
        bias = p.bias.view(np.float32).reshape(-1, lm.CLASSES)
        return [(int(a), int(b), [float(x) for x in c]) for a, b, c in zip(p.nodes, p.branches, bias, strict=True)]

    rows = []  # target, lowered, contexts, trained, document
    for d, ws in enumerate(texts):
        known = [number.get(word_hash(w), 0) for w in ws]
        # a token counts as one of an occurrence less while it trains; where that is another band, its path is that band's
        band_of = lambda n: max([k for k, e in enumerate(lm.EDGES) if e <= n], default=-1)
        below = [bool(n) and band_of(count[word_hash(w)] - 1) < band[word_hash(w)] for n, w in zip(known, ws, strict=True)]
        past = [0, 0, 0]
        for n, b in zip(known, below, strict=True):
            rows.append((n, b, tuple(past), trained(docs[d][0]), d))
            past = [n + 1, *past[:2]]
    weights, squares = {}, {}
    slots = lambda c, node: [(k, (((int(x) ^ node) * 0xD6E8FEB86659FD93) & (2**64 - 1)) >> (64 - bits)) for k, x in enumerate(lm.contexts(*(np.array([v]) for v in c))[:, 0])]

    def chances(c, node, bias):
        z = [b + sum(weights.get((s, i), 0.0) for s in slots(c, node)) for i, b in enumerate(bias)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    use = [r for r in rows if r[3]]
    size = lm.batch_of(len(use))
    for at in range(0, len(use), size):
        grad = Counter()
        for n, b, c, _, _ in use[at : at + size]:
            for node, branch, bias in path(n, b):
                for i, p in enumerate(chances(c, node, bias)):
                    for s in slots(c, node):
                        grad[s, i] += p - (i == branch)
        for k, g in grad.items():
            squares[k] = squares.get(k, 0.0) + g * g
            weights[k] = weights.get(k, 0.0) - lm.RATE * g / math.sqrt(squares[k] + 1)
    scores = [0.0] * len(docs)
    for n, _, c, _, d in rows:
        scores[d] += sum(math.log10(chances(c, node, bias)[branch]) for node, branch, bias in path(n, False))
    return scores


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(words[int(k)] for k in (rng.zipf(1.5, 30) - 1) % 25)) for i in range(60)] + [(100, None), (101, "never seen")]
    trained = lambda d: zlib.crc32(str(d).encode()) % 5 != 1
    rows = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), remainder("doc_id", 5) != 1).collect()}
    assert np.allclose([rows[d] for d, _ in docs], plainly(docs, trained), rtol=1e-4, atol=1e-3)

"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in hashed features of its words (the word and its
first bytes); the document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``.  Only document
labels are needed to train; afterwards the sentence scores locate what offends.

Fitted on a sample bounded by ``labelled.SAMPLE_ROWS`` and ``labelled.SAMPLE_BYTES``; features that fewer
than ``MIN_DOCS`` of its documents hold (a sixteenth of the toxic ones if those are few, but two at least), or that toxic documents
hold no more often than chance explains, have no weight.  Sentences without a weighted feature offend nobody: their probability
is 0.  The cut lies between two different scores, where at least half of the documents above it are toxic and F1 is best; if there
is no such place, no document is called toxic.  Scoring covers every sentence of every text.

Edge cases: null and empty texts have one empty sentence and the least score there is; without labels of both kinds
all documents score alike, by the label there is; equal texts score alike and documents that tie fall on one side of the cut;
rows without an id count as held out; an empty table gives an empty result; extra columns
pass through, result columns replace columns of the same name, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .frames import documents, map_arrow, remainder, set_aside, table, without
from .labelled import fitted, sample, squash

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
MIN_DOCS = 5
SURPRISE = 3.0
STEPS = 150
RATE = 0.3
DECAY = 1e-4
CUT = 0.5
#: Toxic documents that the cut is chosen by, at least; with fewer it is chosen by those that train the weights.
LEAST_TUNED = 10
#: The widest gap of scores that the cut lies in the middle of.
WIDEST = 4.0

#: Bytes that end a sentence: line break, ! . ?
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


@dataclass
class Sentences:
    """Sentences of a chunk: the words of each, in order, and for each document the range of its sentences."""

    words: ts.Spans
    first_word: np.ndarray  # one more than sentences
    bounds: np.ndarray  # one more than documents


def sentences_of(chunk: ts.Chunk) -> Sentences:
    """Runs of words without a sentence end between; a document without words has one empty sentence."""
    words = ts.words(chunk, ts.ALNUM)
    ends = np.flatnonzero(ENDS[chunk.data])
    place = np.searchsorted(ends, words.starts)
    new = np.ones(len(words), bool)
    new[1:] = place[1:] != place[:-1]
    full = words.counts() > 0
    new[words.bounds[:-1][full]] = True
    per_doc = np.maximum(1, np.concatenate([[0], np.cumsum(new)])[words.bounds[1:]] - np.concatenate([[0], np.cumsum(new)])[words.bounds[:-1]])
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    first = np.empty(bounds[-1] + 1, np.int64)
    first[-1] = len(words)
    empty = np.zeros(bounds[-1], bool)
    empty[bounds[:-1][~full]] = True
    first[:-1][~empty] = np.flatnonzero(new)
    first[:-1][empty] = words.bounds[:-1][~full]
    return Sentences(words, first, bounds)


def word_features(chunk: ts.Chunk, words: ts.Spans) -> np.ndarray:
    """Buckets of each word: the word itself and its first bytes; -1 where the word isn't longer than those."""
    out = np.empty((len(words), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = ts.span_hashes(chunk.data, words.starts, words.ends) & np.uint64(BUCKETS - 1)
    for k, n in enumerate(PREFIXES, 1):
        h = ts.mix(ts.span_hashes(chunk.data, words.starts, np.minimum(words.ends, words.starts + n)) + np.uint64(n))
        out[:, k] = h & np.uint64(BUCKETS - 1)
        out[words.ends - words.starts < n, k] = -1
    return out


@dataclass
class Model:
    weights: np.ndarray  # one more than buckets; the last is 0, for -1
    bias: float
    cut: float

    def sentences(self, chunk: ts.Chunk) -> tuple[Sentences, np.ndarray]:
        """Sentences and their log odds, without end where no feature has a weight."""
        found = sentences_of(chunk)
        own = self.weights[word_features(chunk, found.words)]
        sums = np.concatenate([[0.0], np.cumsum(own.sum(axis=1, dtype=float))])
        heard = np.concatenate([[0], np.cumsum((own != 0).any(axis=1))])
        z = self.bias + sums[found.first_word[1:]] - sums[found.first_word[:-1]]
        z[heard[found.first_word[1:]] == heard[found.first_word[:-1]]] = -np.inf
        return found, z

    def documents(self, chunk: ts.Chunk) -> np.ndarray:
        """Raw scores: the log odds of the noisy-or."""
        found, z = self.sentences(chunk)
        return log_odds(np.add.reduceat(softplus(z), found.bounds[:-1]))

    def score(self, chunk: ts.Chunk) -> np.ndarray:
        return squash(self.documents(chunk), self.cut, CUT)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def log_odds(a: np.ndarray) -> np.ndarray:
    """log(p / (1 - p)) of p = 1 - exp(-a)."""
    a = np.clip(a, 1e-12, 500)
    return np.log(-np.expm1(-a)) + a


#: The score of a document without a weighted feature.
LEAST = float(log_odds(np.zeros(1))[0])


def best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """Between two different scores, where F1 is best of all places with a precision of a half or more; above all if there is none."""
    order = np.argsort(-raw, kind="stable")
    hits, n = np.cumsum(labels[order]), np.arange(1, len(raw) + 1)
    f1 = 2 * hits / (n + labels.sum())
    scores = raw[order]
    last = np.append(scores[1:] < scores[:-1], False)  # of its ties, and not of all
    f1[~last | (2 * hits < n)] = 0
    k = int(np.argmax(f1))
    if not f1[k]:
        return float(scores[0]) + 1
    return float((scores[k] + max(scores[k + 1], scores[k] - WIDEST)) / 2)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Full-batch AdaGrad on the likelihood of the noisy-or."""
    weights = np.zeros(BUCKETS + 1)
    if not 0 < labels.sum() < len(labels):
        return Model(weights.astype(np.float32), 0.0, LEAST - 3.0 if len(labels) and labels.all() else LEAST + 6.0)
    y, n = labels.astype(float), len(labels)
    held_by, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for chunk in ts.chunks(texts):
        words = ts.words(chunk, ts.ALNUM)
        f = word_features(chunk, words)
        pairs = np.unique((words.owner()[:, None] * BUCKETS + f)[f >= 0])
        held_by += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        toxic += np.bincount(pairs % BUCKETS, y[chunk.first + pairs // BUCKETS], BUCKETS)
    chance = held_by * y.mean()
    least = min(MIN_DOCS, max(2, int(y.sum()) // 16))
    active = np.flatnonzero((held_by >= least) & (toxic > chance + SURPRISE * np.sqrt(chance)))
    if not len(active):
        return Model(weights.astype(np.float32), 0.0, LEAST + 6.0)
    index = np.full(BUCKETS + 1, -1, np.int32)
    index[active] = np.arange(len(active))
    features, owner, doc, base = [], [], [], 0
    for chunk in ts.chunks(texts):
        found = sentences_of(chunk)
        f = index[word_features(chunk, found.words)]
        sentence = np.repeat(np.arange(len(found.first_word) - 1), np.diff(found.first_word))
        sentence = np.broadcast_to(sentence[:, None], f.shape)[f >= 0]
        heard, place = np.unique(sentence, return_inverse=True)  # sentences with an active feature
        features.append(f[f >= 0])
        owner.append((place + base).astype(np.int32))
        doc.append((chunk.first + np.searchsorted(found.bounds, heard, "right") - 1).astype(np.int32))
        base += len(heard)
    f, s, doc = np.concatenate(features), np.concatenate(owner), np.concatenate(doc)
    del features, owner
    w, g2 = np.zeros(len(active)), np.full(len(active), 1e-8)
    bias, b2 = float(np.log(max(y.mean(), 1e-3) / max(1, len(doc) / n))), 1e-8
    tuned = np.arange(n) % 5 == 4  # these choose the cut
    if y[tuned].sum() < LEAST_TUNED or y[tuned].all():
        tuned[:] = False
    weight = np.where(tuned, 0.0, 1.0) * np.where(y > 0, (n - y.sum()) / y.sum(), 1.0) ** 0.5
    for _ in range(STEPS):
        z = bias + np.bincount(s, w[f], len(doc))
        a = np.bincount(doc, softplus(z), n)
        slope = np.where(y > 0, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0) * weight
        dz = slope[doc] / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.bincount(f, dz[s], len(active)) / n + DECAY * w
        g2 += grad**2
        w -= RATE * grad / np.sqrt(g2)
        gb = dz.sum() / n
        b2 += gb * gb
        bias -= RATE * gb / np.sqrt(b2)
    weights[active] = np.where(w == 0, 1e-9, w)
    raw = log_odds(np.bincount(doc, softplus(bias + np.bincount(s, w[f], len(doc))), n))
    some = tuned if tuned.any() else np.ones(n, bool)
    return Model(weights.astype(np.float32), bias, best_cut(raw[some], labels[some]))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", **options) -> Model:
    return fitted(sample(docs, labels, label, **options), fit)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with toxicity (double, 0 to 1)."""
    docs = without(docs, {"toxicity"}, text)
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(c) for c in ts.chunks(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=schema.names)

    return map_arrow(docs, run, schema)


def locate(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with offending: byte ranges (from, to) and scores of the sentences that reach ``least``."""
    docs = without(docs, {"offending"}, text)
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    item = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("offending", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk in ts.chunks(batch.column(place)):
                found, z = shared.value.sentences(chunk)
                p = squash(z, shared.value.cut, CUT)
                for d in range(len(chunk)):
                    bad = [s for s in range(found.bounds[d], found.bounds[d + 1]) if p[s] >= least and found.first_word[s + 1] > found.first_word[s]]
                    out.append([{"from": int(found.words.starts[found.first_word[s]] - chunk.offsets[d]), "to": int(found.words.ends[found.first_word[s + 1] - 1] - chunk.offsets[d]), "score": float(p[s])} for s in bad])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return map_arrow(docs, run, schema)


def reject(docs: DataFrame, model: Model, *, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without toxic documents; columns stay as they are."""
    held, back = set_aside(docs, {"toxicity"})
    return score(held, model, text=text).where(F.col("toxicity") < cut).select(*back)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))

"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs are a labelled good document and a labelled bad one.  A document's score is linear in its features, and
the logistic loss on the difference of a pair's features is what trains it.  The threshold is a quantile of the scores of
the labelled sample: the share of its bad documents; documents that tie with it are good.

Features of a whole text: frequencies of each ASCII byte and of all other bytes, lengths, shares of capitals and of repeated
neighbouring words, distinct words, repeated lines, and hashed words.  Fitted on a sample of labelled documents
bounded by ``labelled.SAMPLE_ROWS`` and ``labelled.SAMPLE_BYTES``; scoring covers all.

Edge cases: null and empty texts have only the features of length 0 and get a score like any other; without labels of
both kinds every score is the same; equal texts score alike; rows without an id count as held out; an empty table gives an empty
result; extra columns pass through, the result column replaces a column of the same name, whatever its case.
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

WORD_BUCKETS = 1 << 12
PAIRS = 60_000
EPOCHS = 4
BATCH = 512
RATE = 0.1
DECAY = 1e-4
CUT = 0.3
SHAPES = 129 + 8


def features(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features of each document; hashed words as (document, bucket) pairs, each once."""
    n, data = len(chunk), chunk.data
    sizes = np.diff(chunk.offsets)
    owner = np.repeat(np.arange(n), sizes)
    histogram = np.bincount(owner * 129 + np.minimum(data, 128), minlength=n * 129).reshape(n, 129)
    words = ts.words(chunk)
    counts = words.counts()
    hashes = ts.span_hashes(ts.LOWER[data], words.starts, words.ends)
    of = words.owner()
    again = np.zeros(len(words), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    distinct = np.bincount(_distinct(of, hashes)[0], minlength=n)
    lengths = np.bincount(of, words.ends - words.starts, n)
    per = np.maximum(counts, 1)
    breaks = histogram[:, 10]
    dense = np.column_stack([
        np.log1p(1000 * histogram / np.maximum(sizes, 1)[:, None]), np.log1p(sizes), np.log1p(counts), lengths / per,
        10 * histogram[:, 65:91].sum(axis=1) / np.maximum(sizes, 1), 10 * np.bincount(of, again, n) / per, distinct / per, np.log1p(breaks), 10 * breaks / per,
    ])
    plain = ts.words(ts.Chunk(0, ts.LOWER[data], chunk.offsets), ts.ALNUM)
    doc, h = _distinct(plain.owner(), ts.span_hashes(ts.LOWER[data], plain.starts, plain.ends) & np.uint64(WORD_BUCKETS - 1))
    return dense, doc, h.astype(np.int64)


def _distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[new], v[new]


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    cut: float = 0.0

    def raw(self, dense: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        n = len(dense)
        share = np.bincount(doc, self.words[bucket], n) / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        return _scaled(dense, self.centre, self.spread) @ self.weights + share

    def score(self, chunk: ts.Chunk) -> np.ndarray:
        return squash(self.raw(*features(chunk)), self.cut, CUT)


def _scaled(dense: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((dense - centre) / spread, -8, 8)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """AdaGrad on pairs, drawn anew in each epoch."""
    if not 0 < labels.sum() < len(labels):
        zero = np.zeros(SHAPES)
        return Model(zero, zero + 1, zero, np.zeros(WORD_BUCKETS), -3.0 if len(labels) and labels.all() else 3.0)
    dense, rows = [], []
    for chunk in ts.chunks(texts, lower=False):
        d, doc, bucket = features(chunk)
        dense.append(d)
        rows += np.split(bucket, np.cumsum(np.bincount(doc, minlength=len(chunk)))[:-1])
    dense = np.concatenate(dense)
    centre, spread = dense.mean(axis=0), dense.std(axis=0) + 0.05
    x = _scaled(dense, centre, spread)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels > 0), np.flatnonzero(labels == 0)
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    u, h2 = np.zeros(WORD_BUCKETS), np.full(WORD_BUCKETS, 1e-6)
    for _ in range(EPOCHS):
        for at in range(0, PAIRS, BATCH):
            a, b = rng.choice(good, BATCH), rng.choice(bad, BATCH)
            ids = np.concatenate([a, b])
            sizes = np.array([len(rows[i]) for i in ids])
            bucket = np.concatenate([rows[i] for i in ids])
            of = np.repeat(np.arange(2 * BATCH), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            words = np.bincount(of, u[bucket], 2 * BATCH) * scale
            z = (x[a] - x[b]) @ w + words[:BATCH] - words[BATCH:]
            slope = -1 / (1 + np.exp(np.clip(z, -30, 30))) / BATCH
            grad = slope @ (x[a] - x[b]) + DECAY * w
            g2 += grad**2
            w -= RATE * grad / np.sqrt(g2)
            both = np.concatenate([slope, -slope]) * scale
            grad = np.bincount(bucket, both[of], WORD_BUCKETS) + DECAY * u
            h2 += grad**2
            u -= RATE * grad / np.sqrt(h2)
    model = Model(centre, spread, w, u)
    raw = np.concatenate([model.raw(*features(c)) for c in ts.chunks(texts, lower=False)])
    model.cut = float(np.quantile(raw, len(bad) / len(labels)))
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", **options) -> Model:
    return fitted(sample(docs, labels, label, **options), fit)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with quality_score (double, 0 to 1)."""
    docs = without(docs, {"quality_score"}, text)
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(c) for c in ts.chunks(batch.column(place), lower=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=schema.names)

    return map_arrow(docs, run, schema)


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` whose score reaches the threshold; columns stay as they are."""
    held, back = set_aside(docs, {"quality_score"})
    return score(held, model, text=text).where(F.col("quality_score") >= cut).select(*back)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))

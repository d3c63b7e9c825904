"""Scoring by a hashed maximum-entropy language model.

Tokens are white-space words with A-Z lower-cased, and one end token for each text.  The next token is a leaf of a tree, and each
node on its path is a softmax over hashed features of what precedes it: the last token, the last two, and two skip features
(the second and the third last token); what holds without context is in the counts.  Every token met in training has a leaf of its own, and all that never occur share one,
so the probabilities of all known tokens and of "unknown" add up to 1 and each feature can raise each single token.  Leaves
of tokens of like counts form a band; above the bands stands a Huffman tree, below one its tokens by rank, ``CLASSES`` ways
at each node.  Without weights the tree gives smoothed relative frequencies.  As in the Good-Turing estimate, a token of n
occurrences in training counts as one of n - 1 while the tree above the bands is fitted, so tokens that occur once stand for unknown.

1. Each task codes its texts as stretches: numbers of a stretch's own dictionary of token hashes.
2. Dictionaries go by hash range to shards, which add up counts over all training texts, rank the tokens of each band and answer each
   stretch.  What moves is the distinct tokens of each stretch; the driver gets a row of bands for each shard.
3. Tokens go with their features to parts by the last token (by the last two where that is frequent, dealt further where these
   are too).  A part has about ``PART_TOKENS`` tokens, so the number of parts and of feature slots follows the corpus.
   Each learns weights of its own in one pass of mini-batches over its training tokens, then scores all its tokens.
4. Each text's score is the sum over the parts.

Edge cases: null and empty texts are the end token alone; repeated rows are counted and scored each; rows without an id are
scored too, as training texts; without training texts every token is unknown; texts of equal tokens may score differently where their
last two tokens are so frequent that several parts share them; an empty table gives an empty result; the result has its own columns
only, so that extra ones of any name stay behind.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .frames import discard, documents, map_arrow, materialise, remainder, table

STRETCH_BYTES = 8 << 20
SHARD_ENTRIES = 1 << 20
PART_TOKENS = 1 << 20
FREQUENT = 1 << 17
CLASSES = 4  # branches of a node
KINDS = 4  # of features
FEATURES = 1 << 10  # slots of a kind in a part, at least
TOKENS_PER_SLOT = 2
BATCH = 1024, 65536  # training tokens of a step, at least and at most
SCORED = 16384  # tokens scored together
BLOCK = 1 << 14
RATE = 0.2
NEVER = -1e4
END = np.uint64(0x9E3779B97F4A7C15)
#: Least counts of the bands.
EDGES = np.array(sorted({int(2 ** (k / 2)) for k in range(100)}), np.int64)
BANDS = len(EDGES)

_SHARES = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("places", T.BinaryType()),
])
_ANSWERS = T.StructType([
    T.StructField("stretch", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("found", T.BinaryType()),
    T.StructField("kinds", T.ArrayType(T.LongType())), T.StructField("mass", T.ArrayType(T.DoubleType())),
])
_BLOCKS = T.StructType([T.StructField("part", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("block", T.BinaryType())])
_SUMS = T.StructType([T.StructField("stretch", T.LongType()), T.StructField("texts", T.BinaryType()), T.StructField("sums", T.BinaryType())])


def band_of(counts: np.ndarray) -> np.ndarray:
    """-1 for counts of 0."""
    return np.searchsorted(EDGES, counts, "right") - 1


def _hashes(data: np.ndarray, spans: ts.Spans) -> np.ndarray:
    """Of words, some bytes at a time: hashing takes memory of many times the bytes."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(spans):
        a = spans.starts[at]
        to = max(at + 1, int(np.searchsorted(spans.ends, a + ts.CHUNK_BYTES, "right")))
        out.append(ts.span_hashes(data[a : spans.ends[to - 1]], spans.starts[at:to] - a, spans.ends[at:to] - a))
        at = to
    return np.concatenate(out)


def encode(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """Stretches of whole texts: ids, sizes and folds of texts, token numbers, and the dictionary."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("stretch", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("train", T.BinaryType()),
        T.StructField("tokens", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n_train", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("entries", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for chunk in ts.chunks(batch.column(1), size=STRETCH_BYTES):
                spans = ts.words(chunk)
                hashes = _hashes(chunk.data, spans)
                counts = spans.counts()
                tokens = np.insert(hashes, spans.bounds[1:], END)  # each text's end token
                train = np.array(batch.column(2).slice(chunk.first, len(chunk)).to_pylist(), bool)
                unique, place = np.unique(tokens, return_inverse=True)
                seen = np.bincount(place, minlength=len(unique))
                order = np.argsort(-seen, kind="stable")  # small numbers for frequent tokens
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                used = np.repeat(train, counts + 1)
                own = np.bincount(rank[place[used]], minlength=len(unique)).astype(np.int32)
                cells = [(counts + 1).astype(np.int32), train, _pack([rank[place]]), unique[order], own]
                ids = pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), batch.column(0).slice(chunk.first, len(chunk)))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, *(pa.array([c if isinstance(c, bytes) else c.tobytes()], pa.binary()) for c in cells), pa.array([int(used.sum())]), pa.array([len(tokens)]), pa.array([len(unique)])], names=schema.names)
                number += 1

    return map_arrow(docs.select(doc_id, text, train.alias("train")), run, schema)


def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, hashes, counts in zip(*batch.columns, strict=True):
                h, n = np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int32)
                to = ts.mix(h) % np.uint64(shards)
                order = np.argsort(to, kind="stable")
                edges = np.concatenate([[0], np.cumsum(np.bincount(to.astype(np.int64), minlength=shards))])
                full = np.flatnonzero(np.diff(edges))
                own = [order[edges[k] : edges[k + 1]] for k in full]
                cells = [[x[places].tobytes() for places in own] for x in (h, n)] + [[_pack([places]) for places in own]]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([stretch.as_py()] * len(full), pa.int64()), pa.array(list(map(len, own)), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], names=_SHARES.names)

    return run


def _answer(key: tuple, shares: pa.Table) -> pa.Table:
    """Total counts of a shard's tokens and their ranks in the shard's bands, for each stretch, with the places in its dictionary."""
    parts = [shares.column(c).to_pylist() for c in ("hashes", "counts")]
    h, n = (np.concatenate([np.frombuffer(x, kind) for x in part]) for part, kind in zip(parts, (np.uint64, np.int32), strict=True))
    unique, place = np.unique(h, return_inverse=True)
    total = np.bincount(place, n, len(unique)).astype(np.int64)
    band = band_of(total)
    order = np.argsort(band, kind="stable")
    kinds = np.bincount(band + 1, minlength=BANDS + 1)
    rank = np.empty(len(unique), np.int32)
    rank[order] = np.arange(len(unique)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    mass = np.bincount(band_of(np.maximum(total - 1, 0)) + 1, total, BANDS + 1)
    edges = np.cumsum([len(x) // 8 for x in parts[0]])[:-1]
    found = [_pack([total[p], rank[p]]) for p in np.split(place, edges)]
    rest = [None] * (len(found) - 1)
    return pa.table({
        "stretch": shares.column("stretch"), "shard": shares.column("shard"), "n": shares.column("n"), "places": shares.column("places"), "found": pa.array(found, pa.binary()),
        "kinds": pa.array([kinds[1:].tolist(), *rest], pa.list_(pa.int64())), "mass": pa.array([mass.tolist(), *rest], pa.list_(pa.float64())),
    })


@dataclass
class Paths:
    """Ways from the root to some leaves, one after another: nodes, branches taken, and the logs of what each branch holds."""

    starts: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray
    branches: np.ndarray
    bias: np.ndarray


class Tree:
    """Known tokens are numbered from 1, bands of frequent ones first; 0 is unknown."""

    def __init__(self, kinds: np.ndarray, mass: np.ndarray):
        """Tokens of each band, and training tokens (of one occurrence less) of unknown and each band."""
        self.kinds = kinds
        self.first = 1 + kinds[::-1].cumsum()[::-1] - kinds  # number of each band's first token
        self.digits = np.array([next(d for d in itertools.count() if CLASSES**d >= n) for n in kinds.tolist()])
        weight = mass + 0.5 * np.concatenate([[1], kinds])
        leaves = [0, *(np.flatnonzero(kinds) + 1).tolist()]
        heap = [(float(weight[k]), k, (k,)) for k in leaves]
        while (len(heap) - 1) % (CLASSES - 1):
            heap.append((0.0, -len(heap) - 1, ()))
        heapq.heapify(heap)
        ways: dict[int, list] = {k: [] for k in leaves}
        bias = []
        while len(heap) > 1:
            below = [heapq.heappop(heap) for _ in range(CLASSES)]
            for branch, (_, _, own) in enumerate(below):
                for k in own:
                    ways[k].append((len(bias), branch))
            bias.append([np.log(w) if w else NEVER for w, _, _ in below])
            heapq.heappush(heap, (sum(x[0] for x in below), BANDS + len(bias), sum((x[2] for x in below), ())))
        self.top_bias = np.array(bias, np.float32).reshape(-1, CLASSES)
        self.top_sizes = np.zeros(BANDS + 1, np.int64)
        for k, way in ways.items():
            self.top_sizes[k] = len(way)
        self.top_starts = np.cumsum(self.top_sizes) - self.top_sizes
        flat = np.array([step for k in sorted(ways) for step in ways[k][::-1]], np.int64).reshape(-1, 2)
        self.top_nodes, self.top_branches = flat[:, 0], flat[:, 1]

    def known(self) -> int:
        return int(self.kinds.sum())

    def bands(self, numbers: np.ndarray) -> np.ndarray:
        """Of tokens by number; -1 for unknown."""
        return np.where(numbers > 0, BANDS - np.searchsorted(self.first[::-1], numbers, "right"), -1)

    def frequent(self, least: int) -> int:
        """The last number in the bands of at least so many occurrences."""
        return int(self.kinds[EDGES >= least].sum())

    def paths(self, numbers: np.ndarray, below: np.ndarray) -> Paths:
        """To tokens by number; ``below``: to the next lower band, then as in the own band."""
        band = self.bands(numbers)
        used = self.kinds > 0
        lower = np.array([next((j for j in range(k - 1, -1, -1) if used[j]), -1) for k in range(BANDS + 1)])
        leaf = np.where(below, lower[band], band) + 1
        depth = np.where(band >= 0, self.digits[band], 0)
        sizes = self.top_sizes[leaf] + depth
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        nodes, branches, bias = np.zeros(total, np.uint64), np.zeros(total, np.int8), np.zeros((total, CLASSES), np.float32)
        above = self.top_sizes[leaf]
        at, way = ts.expand(starts, above), ts.expand(self.top_starts[leaf], above)
        nodes[at], branches[at], bias[at] = self.top_nodes[way], self.top_branches[way], self.top_bias[self.top_nodes[way]]
        # levels below a band, deepest first: a leaf's number, then those of the nodes above it
        below_it, end = (numbers - self.first[band]), starts + sizes
        base, held = (band + 1).astype(np.uint64) << np.uint64(56), self.kinds[band]
        for up in range(int(depth.max(initial=0))):
            i = np.flatnonzero(depth > up)
            size = CLASSES**up  # leaves below a branch
            child = below_it[i]
            prefix = child // CLASSES
            at = end[i] - 1 - up
            nodes[at] = base[i] + ((depth[i] - up).astype(np.uint64) << np.uint64(50)) + prefix.astype(np.uint64)
            branches[at] = child - prefix * CLASSES
            left = (held[i] - prefix * (CLASSES * size))[:, None] - np.arange(CLASSES) * size
            bias[at] = np.where(left > 0, np.log(np.clip(left, 1, size).astype(np.float32)), np.float32(NEVER))
            below_it[i] = prefix
        return Paths(starts, sizes, ts.mix(nodes + np.uint64(1)), branches, bias.view(np.complex128).ravel())


@dataclass
class Statistics:
    """What all training texts have together."""

    tokens: int
    all_tokens: int  # held-out ones too
    parts: int
    offsets: np.ndarray  # of each shard's ranks in each band
    tree: Tree


def _code(stats: Statistics, schema: T.StructType):
    """From stretches and their answers: numbers of the dictionary, and what the texts have without the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_total = np.log10(stats.tokens + 0.5 * (stats.tree.known() + 1))
        for row in (batch.slice(i, 1) for batch in batches for i in range(len(batch))):
            cell = {c: row.column(row.schema.get_field_index(c)) for c in row.schema.names}
            sizes = np.frombuffer(cell["sizes"][0].as_py(), np.int32)
            [tokens] = _unpack(cell["tokens"][0].as_py(), int(sizes.sum()), 1)
            total, rank, to = np.empty((3, cell["entries"][0].as_py()), np.int64)
            for x in cell["answers"][0]:
                x = x.as_py()
                [places] = _unpack(x["places"], x["n"], 1)
                total[places], rank[places] = _unpack(x["found"], x["n"], 2)
                to[places] = x["shard"]
            band = band_of(total)
            number = np.where(total > 0, stats.tree.first[band] + stats.offsets[to, band] + rank, 0)
            below = (total > 0) & (band_of(total - 1) < band)
            start = np.cumsum(sizes) - sizes
            known = np.add.reduceat((total > 0)[tokens].astype(np.int64), start)
            base = np.add.reduceat((np.log10(total + 0.5) - base_total)[tokens], start)
            cells = [(number * 2 + below).tobytes(), known.tobytes(), base.tobytes()]
            yield pa.RecordBatch.from_arrays([*(cell[c] for c in ("stretch", "ids", "sizes", "train", "tokens")), *(pa.array([x], pa.binary()) for x in cells)], names=schema.names)

    return run


def _pack(columns: list[np.ndarray]) -> bytes:
    """Numbers as planes of their bytes, as most of the higher ones are 0."""
    return pa.compress(b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 6 * n * columns, codec="zstd"), np.uint8).reshape(columns, 6, n)
    out = np.zeros((columns, n, 8), np.uint8)
    out[:, :, :6] = planes.transpose(0, 2, 1)
    return list(out.view(np.int64)[:, :, 0])


def _place(stats: Statistics, stretch: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The part of each token of a stretch, by what precedes it."""
    key = ts.mix(one.astype(np.uint64) + np.uint64(1))
    often = np.flatnonzero(one <= stats.tree.frequent(FREQUENT) + 1)  # also the start of a text and unknown
    pair = ts.mix(key[often] * np.uint64(3) + two[often].astype(np.uint64))
    _, number, many = np.unique(pair, return_inverse=True, return_counts=True)
    # a pair that is frequent as well, as far as this stretch tells, is dealt over several parts by stretch
    ways = np.maximum(1, many * (stats.all_tokens / len(one)) // FREQUENT).astype(np.uint64)
    own = ts.mix(np.array([stretch + 1], np.uint64))[0]
    key[often] = pair + (own % ways)[number]
    return (ts.mix(key) % np.uint64(stats.parts)).astype(np.int64)


def _ship(stats: Statistics):
    """Tokens of stretches with their features, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, sizes, train, tokens, numbers in (row for batch in batches for row in zip(*batch.columns, strict=True)):
            sizes, numbers = np.frombuffer(sizes.as_py(), np.int32), np.frombuffer(numbers.as_py(), np.int64)
            stretch, n, owner = stretch.as_py(), int(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)
            [tokens] = _unpack(tokens.as_py(), n, 1)
            owner = owner.astype(np.int32)
            since = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place in the text
            target = numbers[tokens]
            context = []
            for by in (1, 2, 3):
                moved = np.zeros(n, np.int64)  # 0: before the text
                moved[by:] = (target[:-by] >> 1) + 1
                moved[since < by] = 0
                context.append(moved)
            part = _place(stats, stretch, *context[:2])
            order = np.argsort(part, kind="stable")
            edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=stats.parts))])
            columns = [x[order] for x in (target * 2 + np.repeat(np.frombuffer(train.as_py(), bool), sizes), *context, owner)]
            for k in np.flatnonzero(np.diff(edges)):
                own = [x[edges[k] : edges[k + 1]] for x in columns]
                own[-1] = np.diff(own[-1], prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([stretch], pa.int64()), pa.array([len(own[0])], pa.int64()), pa.array([_pack(own)], pa.binary())], names=_BLOCKS.names)

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


class Model:
    """The weights of one part: ``slots`` for each kind of feature and branch, which follow its training tokens."""

    def __init__(self, n_train: int):
        self.bits = (max(FEATURES, -(-n_train // TOKENS_PER_SLOT)) - 1).bit_length()
        self.weights = np.zeros((KINDS, 1 << self.bits, CLASSES), np.float32)
        self.squares = np.zeros_like(self.weights)

    def look(self, paths: Paths, target: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Rows of the paths, sizes of each token's path, slots of the features by kind, and each branch's probability."""
        sizes = paths.sizes[target]
        rows = ts.expand(paths.starts[target], sizes)
        nodes, shift, slots = paths.nodes[rows], np.uint64(64 - self.bits), []
        z, part = np.take(paths.bias, rows).view(np.float32), np.empty(len(rows), np.complex128)
        for k in range(KINDS):
            h = np.repeat(context[k], sizes)
            h ^= nodes
            h *= np.uint64(0xD6E8FEB86659FD93)
            h >>= shift
            slots.append(h.view(np.int64))
            # the weights of a slot's branches are taken as one number of 16 bytes
            np.take(self.weights[k].view(np.complex128).ravel(), slots[k], out=part, mode="clip")
            z += part.view(np.float32)
        return rows, sizes, slots, _softmax(np.ascontiguousarray(z.reshape(-1, CLASSES).T))

    def learn(self, paths: Paths, target: np.ndarray, context: np.ndarray) -> None:
        """One mini-batch: gradients of each slot are added up, steps shrink with what a slot has seen."""
        rows, _, slots, p = self.look(paths, target, context)
        p[paths.branches[rows], np.arange(len(rows))] -= 1
        # gradients of two branches add up as one number
        pairs = np.ascontiguousarray(p.T).view(np.complex64)
        for k in range(KINDS):
            sums = np.zeros((1 << self.bits, CLASSES // 2), np.complex64)
            for half in range(CLASSES // 2):
                np.add.at(sums[:, half], slots[k], pairs[:, half])
            g = sums.view(np.float32)
            for at in range(0, len(g), BLOCK):  # in pieces that a core's cache holds
                own, squares = g[at : at + BLOCK], self.squares[k, at : at + BLOCK]
                squares += own * own
                own *= RATE
                own /= np.sqrt(squares + np.float32(1))
                self.weights[k, at : at + BLOCK] -= own

    def logs(self, paths: Paths, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log probability of each target."""
        rows, sizes, _, p = self.look(paths, target, context)
        logs = np.log10(np.minimum(p[paths.branches[rows], np.arange(len(rows))], 1) + np.float32(1e-30)).astype(np.float64)
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))


def batch_of(n_train: int) -> int:
    """Training tokens of a step: the fewer a part has, the more steps it takes, as a step costs as much as the part has slots."""
    return min(max(BATCH[0], n_train * n_train >> 23), BATCH[1])


def contexts(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Hashes of the features of each kind."""
    a, b, c = (x.astype(np.uint64) for x in (one, two, three))
    salt = lambda k: np.uint64(k) << np.uint64(56)
    return np.stack([ts.mix(a + salt(1)), ts.mix(ts.mix(a + salt(2)) + b), ts.mix(b + salt(3)), ts.mix(c + salt(4))])


def _learn_and_score(shared):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value.tree
        rows = sorted(((s.as_py(), n.as_py(), b.as_py()) for batch in batches for s, n, b in zip(*(batch.column(c) for c in ("stretch", "n", "block")), strict=True)), key=lambda r: r[0])
        value, one, two, three, owner = (np.concatenate(x) for x in zip(*(_unpack(b, n, 5) for _, n, b in rows), strict=True))
        unique, target = np.unique(value >> 1, return_inverse=True)
        rows = [(s, n) for s, n, _ in rows]
        context = contexts(one, two, three)
        del one, two, three
        use = np.flatnonzero(value & 1)
        del value
        model = Model(len(use))
        paths = tree.paths(unique >> 1, (unique & 1) > 0)
        size = batch_of(len(use))
        for at in range(0, len(use), size):
            model.learn(paths, target[use[at : at + size]], context[:, use[at : at + size]])
        model.squares = None
        paths = tree.paths(unique >> 1, np.zeros(len(unique), bool))
        logs = np.concatenate([model.logs(paths, target[at : at + SCORED], context[:, at : at + SCORED]) for at in range(0, len(target), SCORED)])
        at = 0
        for stretch, n in rows:
            texts, place = np.unique(np.cumsum(owner[at : at + n]), return_inverse=True)
            sums = np.bincount(place, logs[at : at + n])
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), pa.array([texts.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=_SUMS.names)

    return run


def _finish(stats: Statistics, schema: T.StructType):
    """Rows of the texts of a stretch, with the sums of the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1) for batch in batches for i in range(len(batch))):
            cell = {c: row.column(row.schema.get_field_index(c))[0] for c in row.schema.names}
            sizes, train, known, base = (np.frombuffer(cell[c].as_py(), kind) for c, kind in (("sizes", np.int32), ("train", bool), ("known", np.int64), ("base", np.float64)))
            value = np.zeros(len(sizes))
            # in one order, so that sums are the same from run to run
            for x in sorted(cell["found"].as_py(), key=lambda x: (x["texts"], x["sums"])):
                value[np.frombuffer(x["texts"], np.int32)] += np.frombuffer(x["sums"], np.float32)
            columns = [~train, sizes.astype(np.int64), known, np.full(len(sizes), stats.tokens), base, value]
            yield pa.RecordBatch.from_arrays([cell["ids"].values, *map(pa.array, columns)], names=schema.names)

    return run


def release(spark) -> None:
    """Let Spark delete the shuffle files of steps that are written: it does once their plans are collected as garbage, on both sides."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, by a model of the rows where ``train`` holds."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    stretches = materialise(encode(docs, doc_id, text, train), "stretches")
    n_train, n_tokens, entries, n_stretches = stretches.agg(F.sum("n_train"), F.sum("n_tokens"), F.sum("entries"), F.count("*")).first()
    if entries is None:
        return docs.sparkSession.createDataFrame([], schema)
    shards = -(-entries // SHARD_ENTRIES)
    shares = map_arrow(stretches.select("stretch", "hashes", "counts"), _deal(shards), _SHARES)
    answers = materialise(shares.groupBy("shard").applyInArrow(_answer, _ANSWERS), "answers")

    del shares
    release(docs.sparkSession)
    kinds, mass = np.zeros((shards, BANDS), np.int64), np.zeros(BANDS + 1)
    for r in answers.where(F.col("kinds").isNotNull()).select("shard", "kinds", "mass").collect():  # a row for each shard
        kinds[r.shard] = r.kinds
        mass += r.mass
    stats = Statistics(n_train, n_tokens, -(-n_tokens // PART_TOKENS), np.cumsum(kinds, axis=0) - kinds, Tree(kinds.sum(axis=0), mass))

    by_stretch = answers.groupBy("stretch").agg(F.collect_list(F.struct("shard", "n", "places", "found")).alias("answers"))
    binary = [T.StructField(c, T.BinaryType()) for c in ("sizes", "train", "tokens", "numbers", "known", "base")]
    coded_schema = T.StructType([T.StructField("stretch", T.LongType()), stretches.schema["ids"], *binary])
    asked = stretches.drop("hashes", "counts", "n_train", "n_tokens").repartition(n_stretches, "stretch").join(by_stretch.repartition(n_stretches, "stretch"), "stretch")
    coded = materialise(map_arrow(asked, _code(stats, coded_schema), coded_schema), "coded")
    discard(stretches)
    discard(answers)
    del asked, by_stretch, stretches, answers
    release(docs.sparkSession)

    blocks = map_arrow(coded.select("stretch", "sizes", "train", "tokens", "numbers"), _ship(stats), _BLOCKS)
    # parts are few and large: with more partitions than parts, few share one
    sums = blocks.repartition(3 * stats.parts, "part").groupBy("part").applyInArrow(_learn_and_score(sc.broadcast(stats)), _SUMS)
    found = sums.groupBy("stretch").agg(F.collect_list(F.struct("texts", "sums")).alias("found"))
    return map_arrow(coded.drop("tokens", "numbers").join(found, "stretch"), _finish(stats, schema), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return score(docs, remainder("doc_id", 5) != 1)

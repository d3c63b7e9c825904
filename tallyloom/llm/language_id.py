"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (its pieces and its 256 byte pieces).  The
probability of a word is the sum over all its segmentations into pieces, found by a forward algorithm; a document's score
adds its words' log probabilities and the language's share of the training documents.

Piece probabilities are learned by expectation maximisation over all training documents: each round sends the
probabilities to the tasks, gets expected piece counts back (a forward-backward pass over the distinct words of a
stretch of text), and sums them by language and piece.  Their number is languages times vocabulary, whatever the input.

Words are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased and a space mark in front.  They are never cut;
in a batch with a word of over ``PLAIN`` bytes every probability has an exponent of its own, so that none vanishes, and
memory is bounded by the longest word.  The vocabulary is every piece that such a word can contain, in lower case: pieces of letters,
of non-ASCII characters, and those with one space mark in front.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without training documents all
are; null languages and texts are left out of training; repeated rows count each time; rows without an id count as trained on;
languages that tie go by name; an empty table gives an empty
result; extra columns pass through, result columns replace columns of the same name, whatever their case.
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
from .frames import documents, map_arrow, remainder, without
from .token_counts import default_model, model_bytes

PLAIN = 40
ROUNDS = 2
SMOOTHING = 0.01
FOLDS, HELD_OUT = 4, 2
SCAN_BYTES = 4 << 20
WORDS_AT_ONCE = 1 << 14
CELLS = 1 << 20
KEPT_WORDS = 1 << 20
UNDETERMINED = "und"

#: The exponent of 0.
NEVER = -(1 << 30)

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


class Vocabulary:
    """Pieces by length in bytes: their hashes and ids.  Ids below 256 are single bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        skip = lambda i: library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)
        texts = {library.id_to_piece(i).replace("▁", " ").lower().encode() for i in range(library.get_piece_size()) if not skip(i)}
        usable = sorted(t for t in texts if len(t) > 1 and not t[1:].count(b" ") and all(LETTERS[c] for c in t.lstrip(b" ")) and t.strip())
        self.size = 256 + len(usable)
        self.by_length: dict[int, tuple[ts.Lookup, np.ndarray]] = {}
        for n in sorted({len(t) for t in usable}):
            at = [i for i, t in enumerate(usable) if len(t) == n]
            data = np.frombuffer(b"".join(usable[i] for i in at), np.uint8)
            starts = np.arange(len(at)) * n
            self.by_length[n] = ts.Lookup(ts.span_hashes(data, starts, starts + n)), np.array(at, np.int64) + 256


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary_of(model: bytes) -> Vocabulary:
    key = hash(model)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


class Lattice:
    """All segmentations of some words, which stand one after another in ``data``, each with its space mark."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.sizes, self.words = ends - starts, len(starts)
        self.longest = int(self.sizes.max(initial=0))
        word = np.repeat(np.arange(self.words), self.sizes)
        since = np.arange(len(data)) - np.repeat(starts, self.sizes)
        left = self.sizes[word] - since
        at, size, piece = [np.arange(len(data))], [np.ones(len(data), np.int64)], [data.astype(np.int64)]
        hashes = ts.Windows(data)
        for n, (pieces, ids) in vocabulary.by_length.items():
            begin = np.flatnonzero(left >= n)
            if not len(begin):
                continue
            k = pieces.find(hashes.of(begin, n))
            some = np.flatnonzero(k >= 0)
            at.append(begin[some])
            size.append(np.full(len(some), n))
            piece.append(ids[k[some]])
        at, size, self.piece = map(np.concatenate, (at, size, piece))
        # places of arcs in tables of (position, word)
        self.begin = since[at] * self.words + word[at]
        self.end = self.begin + size * self.words

    def _runs(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs in the order of places; where the arcs of each place begin, those places, and where the places of each position begin."""
        order = np.argsort(by, kind="stable")
        place = by[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        return order, first, place[first], np.searchsorted(place[first], np.arange(self.longest + 2) * self.words)

    def _sums(self, table: np.ndarray, powers: np.ndarray | None, by: np.ndarray, source: np.ndarray, p: np.ndarray, positions: range) -> None:
        """Fill a table position by position: each place takes the sum over its arcs of ``p`` times what stands at the arc's other end."""
        order, first, places, edges = self._runs(by)
        source, piece = source[order], self.piece[order]
        ends = np.append(first[1:], len(order))
        for t in positions:
            a, b = edges[t], edges[t + 1]
            if a == b:
                continue
            arcs = slice(first[a], ends[b - 1])
            values = table[source[arcs]] * p[piece[arcs]]
            begins = first[a:b] - first[a]
            if powers is None:
                table[places[a:b]] += np.add.reduceat(values, begins)
                continue
            # with exponents: of each place's arcs the largest is taken out
            own = powers[source[arcs]]
            most = np.maximum.reduceat(own, begins)
            of = np.repeat(np.arange(b - a), ends[a:b] - first[a:b])
            sums = np.add.reduceat(np.ldexp(values, np.maximum(own - most[of], -2000)), begins)
            sums, more = np.frexp(sums)
            table[places[a:b]], powers[places[a:b]] = sums, np.where(sums > 0, most + more, NEVER)

    def _table(self, columns: int) -> tuple[np.ndarray, np.ndarray | None]:
        shape = ((self.longest + 1) * self.words, columns)
        return np.zeros(shape), np.full(shape, NEVER, np.int32) if self.longest > PLAIN + 1 else None

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """At each position of each word, the probability of all segmentations up to it, for each column of ``p``; its exponents of 2, if there are."""
        alpha, powers = self._table(p.shape[1])
        alpha[: self.words] = 1
        if powers is not None:
            powers[: self.words] = 0
        self._sums(alpha, powers, self.end, self.begin, p, range(1, self.longest + 1))
        return alpha, powers

    def _last(self) -> np.ndarray:
        return self.sizes * self.words + np.arange(self.words)

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        alpha, powers = self.forward(p)
        return np.log(alpha[self._last()]) + (0 if powers is None else powers[self._last()] * np.log(2))

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts by column, with ``weights`` (words by columns) as the words' counts."""
        alpha, up = self.forward(p)
        beta, down = self._table(p.shape[1])
        last = self._last()
        if up is None:
            beta[last] = weights / alpha[last]
        else:
            beta[last], down[last] = weights / alpha[last], -up[last]
        self._sums(beta, down, self.begin, self.end, p, range(self.longest - 1, -1, -1))
        counts = np.zeros((len(p), p.shape[1]))
        for c in range(p.shape[1]):
            mass = alpha[self.begin, c] * p[self.piece, c] * beta[self.end, c]
            if up is not None:
                mass = np.ldexp(mass, np.clip(up[self.begin, c] + down[self.end, c], -2000, 1000))
            counts[:, c] = np.bincount(self.piece, mass, len(p))
        return counts


def _words(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: owner and number (in ``unique``) of each word, and byte ranges of the distinct ones."""
    spans = ts.words(chunk, LETTERS)
    _, first, number = np.unique(ts.span_hashes(chunk.data, spans.starts, spans.ends), return_index=True, return_inverse=True)
    return spans.owner(), number, spans.starts[first], spans.ends[first]


class Distinct:
    """Distinct words of several chunks: hashes in order, bytes, and a row of numbers for each."""

    def __init__(self, columns: int):
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, columns))
        self.data, self.starts, self.ends = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known hashes, -1 for others."""
        if not len(self):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[k] == hashes, k, -1)

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
        """Add the values of known words to theirs, and the words that are new."""
        hashes = ts.span_hashes(data, starts, ends)
        at = self.find(hashes)
        self.values[at[at >= 0]] += values[at >= 0]
        new = np.flatnonzero(at < 0)
        size = (ends - starts)[new]
        own = np.cumsum(size) + len(self.data)
        self.starts, self.ends = np.concatenate([self.starts, own - size]), np.concatenate([self.ends, own])
        self.data = np.concatenate([self.data, data[ts.expand(starts[new], size)]])
        self.hashes, self.values = np.concatenate([self.hashes, hashes[new]]), np.concatenate([self.values, values[new]])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.values, self.starts, self.ends = self.hashes[order], self.values[order], self.starts[order], self.ends[order]


def _lattices(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, columns: int) -> Iterator[tuple[slice, Lattice]]:
    """Words of similar length together (they come by length), as many as a table of ``CELLS`` holds."""
    at = 0
    while at < len(starts):
        # as many of the next words as fit at the length of the last of them
        some = (ends - starts)[at : at + WORDS_AT_ONCE]
        fit = np.arange(1, len(some) + 1) * (some + 2) * columns <= CELLS
        part = slice(at, at + max(1, int(fit.sum())))
        at = part.stop
        s, size = starts[part], (ends - starts)[part]
        begin = np.cumsum(size + 1) - size - 1
        own = np.full(int((size + 1).sum()), 32, np.uint8)
        own[ts.expand(begin + 1, size)] = data[ts.expand(s, size)]
        yield part, Lattice(vocabulary, own, begin, begin + size + 1)


@dataclass
class Model:
    """Languages, the logs of their shares, piece probabilities (pieces and a row of zeros, by language)."""

    languages: list[str]
    prior: np.ndarray
    pieces: np.ndarray

    def logs(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        logs = np.zeros((len(starts), len(self.languages)))
        order = np.argsort(ends - starts, kind="stable")
        for part, lattice in _lattices(vocabulary, data, starts[order], ends[order], len(self.languages)):
            logs[order[part]] = lattice.logs(self.pieces)
        return logs

    def score(self, vocabulary: Vocabulary, chunk: ts.Chunk, known: Distinct) -> np.ndarray:
        """Log likelihood of each text in each language; ``known`` keeps words from chunk to chunk."""
        owner, number, starts, ends = _words(chunk)
        at = known.find(ts.span_hashes(chunk.data, starts, ends))
        new = np.flatnonzero(at < 0)
        logs = np.zeros((len(starts), len(self.languages)))
        logs[at >= 0] = known.values[at[at >= 0]]
        logs[new] = self.logs(vocabulary, chunk.data, starts[new], ends[new])
        if len(known) < KEPT_WORDS:
            known.add(chunk.data, starts[new], ends[new], logs[new])
        return np.stack([self.prior[k] + np.bincount(owner, logs[number, k], len(chunk)) for k in range(len(self.languages))], axis=1)


def _has_letter(chunk: ts.Chunk) -> np.ndarray:
    n, owner = len(chunk), np.repeat(np.arange(len(chunk)), np.diff(chunk.offsets))
    ascii_letters = np.bincount(owner, (chunk.data >= 97) & (chunk.data <= 122), n) > 0
    for d in np.flatnonzero(~ascii_letters & (np.bincount(owner, chunk.data >= 128, n) > 0)):
        text = chunk.data[chunk.offsets[d] : chunk.offsets[d + 1]].tobytes().decode("utf-8", "replace")
        ascii_letters[d] = any(c.isalpha() for c in text)
    return ascii_letters


def train(docs: DataFrame, *, lang: str = "lang", text: str = "text", path: str | None = None, rounds: int = ROUNDS) -> Model:
    """A model of every language that a document with a text has."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    seen = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(seen)
    if not languages:
        return Model([], np.zeros(0), np.zeros((257, 0)))
    model = spark.sparkContext.broadcast(model_bytes(path or default_model()))
    size = vocabulary_of(model.value).size
    pieces = np.vstack([np.full((size, len(languages)), 1 / size), np.zeros((1, len(languages)))])
    numbers = {x: i for i, x in enumerate(languages)}
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("language", T.IntegerType()), T.StructField("n", T.DoubleType())])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((numbers, pieces))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, (numbers, pieces) = vocabulary_of(model.value), shared.value
            total, columns = np.zeros(pieces.shape), pieces.shape[1]
            words = Distinct(columns)

            def expected(words: Distinct) -> np.ndarray:
                order = np.argsort(words.ends - words.starts, kind="stable")
                parts = _lattices(vocabulary, words.data, words.starts[order], words.ends[order], columns)
                return sum((lattice.expected(pieces, words.values[order[part]]) for part, lattice in parts), np.zeros(pieces.shape))

            for batch in batches:
                column = np.array([numbers[x] for x in batch.column(0).to_pylist()], np.int64)
                for chunk in ts.chunks(batch.column(1), size=SCAN_BYTES):
                    owner, number, starts, ends = _words(chunk)
                    weights = np.bincount(number * columns + column[chunk.first + owner], minlength=len(starts) * columns).reshape(len(starts), columns)
                    words.add(chunk.data, starts, ends, weights.astype(float))
                    if len(words) >= KEPT_WORDS:
                        total += expected(words)
                        words = Distinct(columns)
            total += expected(words)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=schema.names)

        summed = map_arrow(known, expect, schema).groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(pieces.shape)
        counts[summed.column(0).to_numpy(), summed.column(1).to_numpy()] = summed.column(2).to_numpy()
        pieces = (1 - SMOOTHING) * counts / np.maximum(counts.sum(axis=0), 1e-9) + SMOOTHING / size
        pieces[-1] = 0
    share = np.array([seen[x] for x in languages], float)
    return Model(languages, np.log(share / share.sum()), pieces)


def identify(docs: DataFrame, model: Model, *, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and lang_score: the likeliest language and its posterior."""
    docs = without(docs, {"lang_pred", "lang_score"}, text)
    sc = docs.sparkSession.sparkContext
    place, shared, pieces = docs.columns.index(text), sc.broadcast(model), sc.broadcast(model_bytes(path or default_model()))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value, vocabulary_of(pieces.value)
        known = Distinct(len(model.languages))
        for batch in batches:
            names, scores = [], []
            for chunk in ts.chunks(batch.column(place), size=SCAN_BYTES):
                if not model.languages:
                    names += [UNDETERMINED] * len(chunk)
                    scores += [0.0] * len(chunk)
                    continue
                raw = model.score(vocabulary, chunk, known)
                best = raw.argmax(axis=1)
                sure = 1 / np.exp(raw - raw.max(axis=1, keepdims=True)).sum(axis=1)
                letters = _has_letter(chunk)
                names += [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                scores += np.where(letters, sure, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_arrow(docs, run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = remainder("doc_id", FOLDS)
    model = train(docs.where(fold != HELD_OUT))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

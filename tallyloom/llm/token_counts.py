"""Exact token counts at every prefix of a text, for byte-fallback piece BPE models.

In BPE with a fixed order of merges, a sequence of pieces is the encoding of its text if and only if each
neighbouring pair is what the pair's own text encodes to.  So the encoding of a prefix ends with the one piece that fits
the last piece of what comes before it, and a dynamic programme over prefixes stores last piece and count at each:
counts of prefixes, truncation to a budget and budget checks need no second encoding.

No piece of the vocabulary joins a word with a following space, line break or tab (checked when a model is
loaded), so counts add up over segments: a run of spaces with the word behind it, a break, or spaces alone.  Runs
of spaces merge last and by their length only; the library itself counts them.  Segments are counted once
for each worker and kept in a bounded table.

The segments of some texts that a worker hasn't met go through the programme together, one more character of each at a step,
in numpy.  Whether two pieces fit follows from undoing their merges, the latest first: they do unless an earlier merge across
their border was open.  Words of over ``ALONE`` characters go through the same programme one by one.

Edge cases: null and empty texts have 0 tokens; characters outside the vocabulary count their UTF-8 bytes;
words of any length take linear time; extra columns pass through, result columns replace columns of the same
name, whatever their case; empty tables give empty results; repeated rows are counted one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .frames import documents, map_arrow, without

SPACE = "▁"
SEGMENT = re.compile(r" *[^ \n\t]+| +|[\n\t]")
KEPT_SEGMENTS = 1 << 19
KEPT_PAIRS = 1 << 20
PAIR_BITS = 20
ALONE = 64
GROUP_CHARS = 1 << 20
LIMIT = 4096


class Merges:
    """Pieces by number, what each was merged of last, and which pairs merge."""

    def __init__(self, pieces: list[str], rank: dict[str, int], last_merge: dict[str, tuple[str, str]]):
        number = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        # pieces of one character aren't merged: they come before all merges
        self.rank = np.array([rank[p] if p in last_merge else -1 for p in pieces], np.int64)
        self.left, self.right = (np.array([number[last_merge[p][side]] if p in last_merge else i for i, p in enumerate(pieces)], np.int64) for side in (0, 1))
        joined = {(number[p[:k]] * self.n + number[p[k:]]): r for p, r in rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pairs = ts.Lookup(np.array(list(joined), np.uint64))
        self.pair_rank = np.array([*joined.values(), np.iinfo(np.int64).max], np.int64)  # the last: no merge
        self.seen = np.full(1 << PAIR_BITS, -1, np.int64)  # pairs met, one for each slot, with the answer as last bit
        self.lookups: list[tuple[int, ts.Lookup, np.ndarray]] = []
        for size in sorted({len(p) for p in pieces}, reverse=True):
            own = [p for p in pieces if len(p) == size]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
            h = ts.window_hashes(ts.mix(codes.astype(np.uint64)), size)[::size]
            self.lookups.append((size, ts.Lookup(h), np.array([number[p] for p in own], np.int32)))

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the pieces ``a`` and ``b`` stay apart when their text is encoded?"""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            crossing = self.pair_rank[self.pairs.find((a * self.n + b).astype(np.uint64))]
            bad = crossing < limit
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            # of equal merges the left one came first, so the right one is undone first
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        slot = (key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIR_BITS)
        got = self.seen[slot]
        out = (got & 1).astype(bool)
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            found = self._decide(pairs // self.n, pairs % self.n)
            out[new] = found[back]
            self.seen[slot[new]] = key[new] * 2 + out[new]
        return out

    def counts(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each character of words (longest first, one after another in ``codes``): tokens up to it, and whether the first is one character."""
        n = len(codes)
        since = np.arange(n) - np.repeat(starts, sizes)
        hashes = ts.mix(codes.astype(np.uint64))
        ending: list[tuple[int, np.ndarray]] = []
        for size, lookup, numbers in self.lookups:
            piece = np.full(n, -1, np.int32)
            at = np.flatnonzero(since[size - 1 :] >= size - 1) + size - 1
            if len(at):
                k = lookup.find(ts.window_hashes(hashes, size)[at - size + 1])
                piece[at[k >= 0]] = numbers[k[k >= 0]]
                ending.append((size, piece))
        counts, last, bare = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n, bool)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            left = starts[: np.searchsorted(-sizes, -i, "left")] + i
            for size, piece in ending:
                if size > i + 1 or not len(left):
                    continue
                own = piece[left]
                ok = own >= 0
                if size <= i:
                    before = last[left - size]
                    asked = np.flatnonzero(ok & (before >= 0))
                    ok[asked] = self.fit(before[asked], own[asked])
                at = left[ok]
                last[at] = own[ok]
                counts[at] = (counts[at - size] if size <= i else 0) + 1
                bare[at] = bare[at - size] if size <= i else size == 1
                left = left[~ok]
            if len(left):  # not in the vocabulary: their bytes
                c = codes[left]
                counts[left] = (counts[left - 1] if i else 0) + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                bare[left] = bare[left - 1] if i else False
        return counts, bare


class PrefixCounter:
    """Counts of a piece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        ids = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        joined = [p for p in self.score if any(c in p for c in "\n\t") or (SPACE in p[1:] and p.strip(SPACE))]
        if joined:
            raise ValueError(f"pieces cross word boundaries: {joined[:5]}")
        last_merge: dict[str, tuple[str, str]] = {}
        self.single = {p for p in self.score if self._encode(p, last_merge) == [p]}
        if odd := {c for p in self.single for c in p} - self.single:
            raise ValueError(f"characters of pieces that are no pieces: {sorted(odd)[:5]}")
        by_score = sorted(self.score.values(), reverse=True)
        order = dict(zip(by_score, range(len(by_score)), strict=True))
        self.merges = Merges(sorted(self.single), {p: order[x] for p, x in self.score.items()}, {p: last_merge[p] for p in self.single if p in last_merge})
        lengths: dict[str, set[int]] = {}
        for p in self.single:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: tuple(sorted(n, reverse=True)) for c, n in lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, int] = {0: 0}
        self.segments: dict[str, int] = {}

    def _encode(self, text: str, last_merge: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Plain merging of a short text: the best neighbouring pair first, the leftmost of equals; ``last_merge`` takes the last."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if last_merge is not None:
                last_merge[text] = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._encode(a + b) == [a, b]
        return found

    def run(self, n: int) -> int:
        """Tokens of ``n`` space marks."""
        if n not in self.runs:
            if len(self.runs) > KEPT_SEGMENTS:
                self.runs = {0: 0}
            self.runs[n] = len(self.library.encode(" " * (n - 1), num_threads=1)) if n > 1 else 1
        return self.runs[n]

    def word(self, word: str) -> tuple[list[int], list[bool]]:
        """For each prefix of a word, which may begin with one space mark: its count, and whether its first token is a bare mark."""
        n = len(word)
        counts, bare, last = [0] * (n + 1), [False] * (n + 1), [""] * (n + 1)
        single, ends, pairs = self.single, self.ends, self.pairs
        for i in range(1, n + 1):
            lengths = ends.get(word[i - 1])
            if lengths is None:  # not in the vocabulary: its bytes
                counts[i] = counts[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass"))
                bare[i] = bare[i - 1]
                continue
            for k in lengths:
                j = i - k
                if j < 0 or (piece := word[j:i]) not in single:
                    continue
                before = last[j]
                if j and before:
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = self._fit(before, piece)
                    if not fits:
                        continue
                counts[i], last[i] = counts[j] + 1, piece
                bare[i] = bare[j] if j else piece == SPACE
                break
            else:
                raise AssertionError(f"no piece ends {word[: i][-40:]!r}")
        return counts, bare

    def segment(self, segment: str) -> list[int]:
        """Counts of a segment's prefixes, the empty one first; spaces stand as marks or spaces."""
        text = segment.replace(" ", SPACE)
        rest = text.lstrip(SPACE)
        spaces = len(text) - len(rest)
        out = [self.run(i) for i in range(spaces + 1)]
        if rest:
            counts, bare = self.word(SPACE + rest if spaces else rest)
            if spaces:
                out += [c + (self.run(spaces) - 1 if b else self.run(spaces - 1)) for c, b in zip(counts[2:], bare[2:], strict=True)]
            else:
                out += counts[1:]
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return SEGMENT.findall(" " + text.replace(SPACE, " ")) if text else []

    def _meet(self, segments: list[str]) -> dict[str, int]:
        """Tokens of segments."""
        out, words = {}, []
        for p in segments:
            rest = p.lstrip(" ")
            spaces = len(p) - len(rest)
            if not rest or len(rest) > ALONE:
                out[p] = self.segment(p)[-1]
            else:
                words.append((-len(rest) - (spaces > 0), p, SPACE + rest if spaces else rest, spaces))
        words.sort(key=lambda w: w[0])
        if words:
            codes = np.frombuffer("".join(w[2] for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.array([-w[0] for w in words])
            starts = np.cumsum(sizes) - sizes
            counts, bare = self.merges.counts(codes, starts, sizes)
            ends = starts + sizes - 1
            for (_, p, _, spaces), c, b in zip(words, counts[ends].tolist(), bare[ends].tolist(), strict=True):
                out[p] = c if spaces < 2 else c + (self.run(spaces) - 1 if b else self.run(spaces - 1))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; new segments of about ``GROUP_CHARS`` characters of texts are counted together."""
        out, at, known = [], 0, self.segments
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= GROUP_CHARS):
                chars += len(texts[to])
                to += 1
            parts = [self.split(t) for t in texts[at:to]]
            if len(known) > KEPT_SEGMENTS:
                known.clear()
            met = self._meet(list({p for own in parts for p in own if p not in known}))
            known.update(met)
            out += [sum(map(known.__getitem__, own)) for own in parts]
            for p in met:
                if len(p) > ALONE:
                    del known[p]
            at = to
        return out

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of each prefix of ``text`` by code points, the empty prefix first."""
        out, total = [0], 0
        for k, p in enumerate(self.split(text)):
            counts = self.segment(p)
            out += [total + c for c in counts[2 if k == 0 else 1 :]]
            total += counts[-1]
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return text[: int(fits[-1])] if len(fits) else ""


_loaded: dict[int, PrefixCounter] = {}


def counter_of(model: bytes) -> PrefixCounter:
    """One counter for each model and worker."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PrefixCounter(model)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _map(docs: DataFrame, path: str | None, text: str, fields: list[T.StructField], fn) -> DataFrame:
    """``docs`` with ``fields``, computed from the list of texts (never null) by ``fn(counter, texts)``."""
    docs = without(docs, {f.name for f in fields}, text)
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path or default_model()))
    schema = T.StructType([*(f for f in docs.schema.fields), *(f for f in fields if f.name != text)])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(counter, batch.column(place))], names=schema.names)

    return map_arrow(docs, run, schema)


def count_tokens(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (long)."""

    def count(counter: PrefixCounter, column: pa.Array) -> list[pa.Array]:
        return [pa.array(counter.counts([x.as_py() or "" for x in column]), pa.int64())]

    return _map(docs, path, text, [T.StructField("n_tokens", T.LongType())], count)


def prefix_counts(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with prefix_tokens: for each number of code points from 0 on, the tokens of that prefix."""

    def count(counter: PrefixCounter, column: pa.Array) -> list[pa.Array]:
        return [pa.array([counter.prefixes(x.as_py() or "") for x in column], pa.list_(pa.int64()))]

    return _map(docs, path, text, [T.StructField("prefix_tokens", T.ArrayType(T.LongType()))], count)


def truncate(docs: DataFrame, budget: int, *, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with truncated: the longest prefix of each text of at most ``budget`` tokens (null for null)."""

    def cut(counter: PrefixCounter, column: pa.Array) -> list[pa.Array]:
        return [pa.array([None if (t := x.as_py()) is None else counter.truncate(t, budget) for x in column], pa.string())]

    return _map(docs, path, text, [T.StructField("truncated", T.StringType())], cut)


def pack(counts: list[int], budget: int) -> list[int]:
    """How many tokens of each text in turn a budget still takes."""
    ends = np.cumsum(counts)
    whole = bisect_right(ends.tolist(), budget)
    left = budget - (int(ends[whole - 1]) if whole else 0)
    return [*counts[:whole], *([left] if whole < len(counts) else []), *[0] * (len(counts) - whole - 1)]


def op10(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    counted = count_tokens(docs)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

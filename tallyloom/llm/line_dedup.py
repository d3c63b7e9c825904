"""Line dedup with two Bloom filters: hashes seen once, and hashes seen twice.

A text is split at ``\\n``; a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased.

1. Each task fills two filters with its documents' line keys: a key that is new sets its bits in the first, one
   that may have been met before (in another document) sets them in the second.  Filters are cut into blocks
   of fixed size and merged block by block; bits that two tasks share go to the second filter too.  So every key in two
   documents or more is in the second filter; a false alarm costs a little more shuffle and nothing else.
2. Only suspected repeats are counted exactly, by key bytes (their SHA-256) over distinct documents.
3. Repeated keys come back to the documents as a broadcast set.

The filter has ``bits_per_line`` bits for each line.  Where that is more than ``max_bits``, where more than ``broadcast_keys`` keys
are repeated, and with ``keep="first"`` (each repeated key keeps its first line, in the order of the rows as they are read), nothing
is broadcast.  Rows are then dealt to stretches of about ``STRETCH_BYTES`` of whole texts, and the same steps go over the executors:

1. Hashes of a stretch, each key once, go to the blocks of the filters that they fall into.  A block has its own two
   filters, for about ``block_lines`` lines: it fills them, then answers each stretch which of its hashes are in the second.
2. A stretch counts its suspected repeats by key bytes, and the counts of all stretches are added up.
3. Repeated keys go back to the stretches that hold them, with the place of their first line.

After the count of lines and the writing of stretches, that is three scans of the texts and two shuffles of them, whatever the number of lines.  A key in very many documents is a row for each
stretch, so no task holds more than a block's hashes or a stretch.

Edge cases: a null or empty text is one empty line; every row counts as one document even if ids repeat;
keys shorter than ``min_chars`` code points are never dropped; an empty table gives an empty result; extra
columns pass through and columns named as a result column, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .frames import discard, documents, free_name, map_arrow, materialise, without

BLOCK_BITS = 1 << 20
BITS_PER_LINE = 16
MAX_BITS = 1 << 29  # 64 MB a filter
BROADCAST_KEYS = 1 << 20
BLOCK_LINES = 1 << 20
STRETCH_BYTES = 8 << 20
SPACE = b" \t\n\x0b\x0c\r"

_FILTERS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_SUSPECTS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])
_HASHES = T.StructType([T.StructField("block", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("again", T.BooleanType())])
_ANSWERS = T.StructType([T.StructField("stretch", T.LongType()), T.StructField("hash", T.LongType())])
_COUNTS = T.StructType([T.StructField("stretch", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("row", T.LongType()), T.StructField("line", T.LongType())])


def lines_of(chunk: ts.Chunk) -> ts.Spans:
    """Lines between newlines; a document has at least one."""
    breaks = np.flatnonzero(chunk.data == 10)
    per_doc = np.searchsorted(breaks, chunk.offsets)
    n = len(chunk)
    # in order: for each document, its start and then what follows each newline
    bounds = np.concatenate([[0], np.cumsum(np.diff(per_doc) + 1)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    own = np.zeros(bounds[-1], bool)
    own[bounds[:-1]] = True
    starts[own] = chunk.offsets[:-1]
    starts[~own] = breaks + 1
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    ends[last] = chunk.offsets[1:]
    ends[~last] = breaks
    assert n == len(bounds) - 1
    return ts.Spans(starts, ends, bounds)


def strip(chunk: ts.Chunk, spans: ts.Spans) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the keys: lines without white space at either end."""
    n = len(chunk.data)
    solid = ts.NOT_SPACE[chunk.data]
    place = np.flatnonzero(solid)
    i, j = np.searchsorted(place, spans.starts), np.searchsorted(place, spans.ends)
    some = j > i
    padded = np.append(place, n)
    starts = np.where(some, padded[np.minimum(i, len(place))], spans.starts)
    ends = np.where(some, padded[np.maximum(j - 1, 0)] + 1, spans.starts)
    return starts, ends


def keys_of(chunk: ts.Chunk, min_chars: int) -> tuple[ts.Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, their keys' byte ranges and hashes, and which keys are long enough."""
    spans = lines_of(chunk)
    starts, ends = strip(chunk, spans)
    heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])  # bytes that begin a code point
    enough = heads[ends] - heads[starts] >= min_chars
    return spans, starts, ends, ts.span_hashes(chunk.data, starts, ends), enough


def _first_in_document(hashes: np.ndarray, owner: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Indices of the first line of each key in each document."""
    at = np.flatnonzero(enough)
    order = np.lexsort((at, hashes[at], owner[at]))
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = (hashes[at][1:] != hashes[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    return np.sort(at[new])


def _bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _meet(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, again: np.ndarray, n_bits: int) -> None:
    """Put distinct hashes into the filters: those met before, or marked as met ``again``, into the second too."""
    a, b = _bits(hashes, n_bits)
    again = again | (_has(once, a) & _has(once, b))
    for bits in (a, b):
        _set(twice, bits[again])
        _set(once, bits)


def _fill(text: str, min_chars: int, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            for chunk in ts.chunks(batch.column(batch.schema.get_field_index(text))):
                spans, _, _, hashes, enough = keys_of(chunk, min_chars)
                h, many = np.unique(hashes[_first_in_document(hashes, spans.owner(), enough)], return_counts=True)
                _meet(once, twice, h, many > 1, n_bits)
        size = BLOCK_BITS // 8
        for k in range(0, n_bits // 8, size):
            if once[k : k + size].any():
                packed = [zlib.compress(x[k : k + size].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], ["block", "once", "twice"])

    return run


def _merge_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of the filters: what two tasks have once is seen twice."""
    once = twice = None
    for batch in batches:
        for row in zip(batch.column("once"), batch.column("twice"), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in row)
            once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([b""], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["block", "once", "twice"])


def filter_bits(n_lines: int, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS) -> int:
    """A power of two, from one block to ``max_bits``."""
    return min(max_bits, 1 << max(BLOCK_BITS.bit_length() - 1, (max(1, n_lines * bits_per_line) - 1).bit_length()))


def count_lines(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.length(F.col(text)) - F.length(F.translate(text, "\n", "")) + 1)).first()[0] or 0


def seen_twice(docs: DataFrame, text: str, min_chars: int, n_bits: int) -> np.ndarray:
    """The second filter, packed."""
    filters = map_arrow(docs.select(text), _fill(text, min_chars, n_bits), _FILTERS)
    merged = filters.groupBy("block").applyInArrow(_merge_blocks, _FILTERS)
    twice, size = np.zeros(n_bits // 8, np.uint8), BLOCK_BITS // 8
    for row in merged.select("block", "twice").toLocalIterator():  # of bounded size: one filter
        twice[row.block * size : (row.block + 1) * size] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return twice


def _suspected(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _bits(hashes, len(twice) * 8)
    return _has(twice, a) & _has(twice, b)


def _digest(chunk: ts.Chunk, start: int, end: int) -> bytes:
    return hashlib.sha256(chunk.data[start:end].tobytes()).digest()


def repeated_keys(docs: DataFrame, twice, *, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """SHA-256 of the keys that at least ``min_docs`` documents hold, counted exactly among suspected repeats."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in ts.chunks(batch.column(0)):
                spans, starts, ends, hashes, enough = keys_of(chunk, min_chars)
                at = _first_in_document(hashes, spans.owner(), enough)
                at = at[_suspected(twice.value, hashes[at])]
                digests = [_digest(chunk, a, b) for a, b in zip(starts[at], ends[at], strict=True)]
                if digests:
                    counted = pa.table({"key": pa.array(digests, pa.binary()), "n": np.ones(len(at), np.int64)}).group_by("key").aggregate([("n", "sum")])
                    yield from counted.select(["key", "n_sum"]).rename_columns(["key", "n"]).to_batches()

    counts = map_arrow(docs.select(text), suspects, _SUSPECTS).groupBy("key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_docs).select("key")


def _finish(chunk_raw: bytes, spans: ts.Spans, d: int, drop: np.ndarray) -> str:
    a, b = spans.bounds[d], spans.bounds[d + 1]
    kept = np.flatnonzero(~drop[a:b]) + a
    return b"\n".join([chunk_raw[spans.starts[i] : spans.ends[i]] for i in kept]).decode("utf-8", "replace")


def _rewrite(columns: list[pa.Array], place: int, min_chars: int, choose: Callable[[ts.Chunk, ts.Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[pa.Array]:
    """The columns with the kept lines as text, and n_lines, n_dropped; ``choose`` says which lines of a chunk to drop."""
    column = columns[place]
    texts, n_lines, n_dropped = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    data, _ = ts.raw(column)
    data, done = data.tobytes(), 0
    for chunk in ts.chunks(column):
        spans, starts, ends, hashes, enough = keys_of(chunk, min_chars)
        drop = choose(chunk, spans, starts, ends, hashes, enough)
        size = int(chunk.offsets[-1])
        source = data[done : done + size]
        done += size
        total = np.concatenate([[0], np.cumsum(drop)])
        lost = total[spans.bounds[1:]] - total[spans.bounds[:-1]]
        n_lines.append(spans.counts())
        n_dropped.append(lost)
        texts += [_finish(source, spans, d, drop) if lost[d] else None for d in range(len(chunk))]
    n_dropped = np.concatenate(n_dropped)
    new = pc.if_else(pc.and_(pa.array(n_dropped > 0), column.is_valid()), pa.array(texts, pa.string()), column.cast(pa.string()))
    return [*(new if k == place else c for k, c in enumerate(columns)), pa.array(np.concatenate(n_lines)), pa.array(n_dropped)]


def dedup_lines(
    docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS, broadcast_keys: int = BROADCAST_KEYS, block_lines: int = BLOCK_LINES, keep: str = "none"
) -> DataFrame:
    """``docs`` with the kept lines as ``text`` (null stays null), and n_lines, n_dropped (longs).

    ``keep``: "none" drops all lines of a repeated key, "first" all but the first.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep={keep!r}: none or first")
    spark = docs.sparkSession
    docs = without(docs, {"n_lines", "n_dropped"}, text)
    n_lines = count_lines(docs, text)
    spread = lambda: _dedup_spread(docs, text, min_docs, min_chars, n_lines, bits_per_line, block_lines, keep)
    if n_lines * bits_per_line > max_bits or keep == "first":
        return spread()
    twice = spark.sparkContext.broadcast(seen_twice(docs, text, min_chars, filter_bits(n_lines, bits_per_line, max_bits)))
    keys = materialise(repeated_keys(docs, twice, text=text, min_docs=min_docs, min_chars=min_chars), "repeated-lines")
    if keys.count() > broadcast_keys:
        twice.destroy()
        discard(keys)
        return spread()
    dropped = spark.sparkContext.broadcast(frozenset(keys.toArrow().column(0).to_pylist()))
    discard(keys)
    schema, place = _result(docs), docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = dropped.value

        def choose(chunk, spans, starts, ends, hashes, enough) -> np.ndarray:
            drop = enough & _suspected(twice.value, hashes)
            for i in np.flatnonzero(drop):
                drop[i] = _digest(chunk, starts[i], ends[i]) in bad
            return drop

        for batch in batches:
            yield pa.RecordBatch.from_arrays(_rewrite(batch.columns, place, min_chars, choose), names=schema.names)

    return map_arrow(docs, apply, schema)


def _result(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _stretched(docs: DataFrame, text: str, row: str, stretch: str) -> DataFrame:
    """Rows with a number that follows the order they are read in, and the number of their stretch: rows that begin in the
    same ``STRETCH_BYTES`` of a partition, each counted with some bytes more so that stretches of short texts end too."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(row, T.LongType()), T.StructField(stretch, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            begins = size + np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + rows + np.arange(len(batch))), pa.array(first + begins // STRETCH_BYTES)], names=schema.names)
            rows, size = rows + len(batch), size + int(sizes.sum())

    return map_arrow(docs, run, schema)


def _send(min_chars: int, blocks: int):
    """Hashes of the keys of a stretch, by block: each once for a chunk, ``again`` where two documents of the chunk hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stretches = batch.column(1).to_numpy()
            for chunk in ts.chunks(batch.column(0)):
                spans, _, _, hashes, enough = keys_of(chunk, min_chars)
                owner = spans.owner()
                at = _first_in_document(hashes, owner, enough)
                own = stretches[chunk.first + owner[at]]
                order = np.lexsort((hashes[at], own))
                h, own = hashes[at][order], own[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                begin = np.flatnonzero(new)
                many, h = np.diff(np.append(begin, len(h))), h[begin]
                block = (ts.mix(h) % np.uint64(blocks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(own[begin]), pa.array(h.view(np.int64)), pa.array(many > 1)], names=_HASHES.names)

    return run


def _answer(n_bits: int):
    """One block: fill its filters, then say which hashes of which stretch the second one has."""

    def run(shares: pa.Table) -> pa.Table:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        hashes = shares.column("hash").to_numpy().view(np.uint64)
        h, place, many = np.unique(hashes, return_inverse=True, return_counts=True)
        _meet(once, twice, h, (many > 1) | (np.bincount(place, shares.column("again").to_numpy(), len(h)) > 0), n_bits)
        return shares.select(["stretch", "hash"]).filter(pa.array(_suspected(twice, hashes)))

    return run


def _column(rows: pa.Table, name: str) -> pa.Array:
    found = rows.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _count(text: str, row: str, min_chars: int):
    """Suspected repeats of a stretch by key: documents that hold it, and its first line."""

    def run(key: tuple, answers: pa.Table, rows: pa.Table) -> pa.Table:
        known, found = np.unique(answers.column("hash").to_numpy()).view(np.uint64), {}
        if len(known) and len(rows):
            number = rows.column(row).to_numpy()
            for chunk in ts.chunks(_column(rows, text)):
                spans, starts, ends, hashes, enough = keys_of(chunk, min_chars)
                owner = spans.owner()
                at = _first_in_document(hashes, owner, enough)
                for i in at[np.isin(hashes[at], known)]:
                    n, h, first = found.get(digest := _digest(chunk, starts[i], ends[i]), (0, 0, None))
                    own = int(number[chunk.first + owner[i]]), int(i - spans.bounds[owner[i]])
                    found[digest] = n + 1, int(hashes[i : i + 1].view(np.int64)[0]), own if first is None else min(first, own)
        counted = list(found.values())
        return pa.table({
            "stretch": pa.array([key[0].as_py()] * len(found), pa.int64()), "key": pa.array(list(found), pa.binary()), "hash": pa.array([h for _, h, _ in counted], pa.int64()),
            "n": pa.array([n for n, _, _ in counted], pa.int64()), "row": pa.array([f[0] for _, _, f in counted], pa.int64()), "line": pa.array([f[1] for _, _, f in counted], pa.int64()),
        })

    return run


def _drop(text: str, row: str, stretch: str, names: list[str], min_chars: int, keep: str):
    """A stretch without the lines of its repeated keys."""

    def run(key: tuple, repeated: pa.Table, rows: pa.Table) -> pa.Table:
        known = np.unique(repeated.column("hash").to_numpy()).view(np.uint64)
        first = dict(zip(repeated.column("key").to_pylist(), zip(repeated.column("row").to_pylist(), repeated.column("line").to_pylist(), strict=True), strict=True))
        number, own = rows.column(row).to_numpy(), [c for c in rows.column_names if c not in (row, stretch)]

        def choose(chunk, spans, starts, ends, hashes, enough) -> np.ndarray:
            drop, owner = enough & np.isin(hashes, known), spans.owner()
            for i in np.flatnonzero(drop):
                kept = first.get(_digest(chunk, starts[i], ends[i]))
                drop[i] = kept is not None and (keep == "none" or kept != (number[chunk.first + owner[i]], i - spans.bounds[owner[i]]))
            return drop

        return pa.table(_rewrite([_column(rows, c) for c in own], own.index(text), min_chars, choose), names=names)

    return run


def _dedup_spread(docs: DataFrame, text: str, min_docs: int, min_chars: int, n_lines: int, bits_per_line: int, block_lines: int, keep: str) -> DataFrame:
    """The way without broadcasts: filters lie in blocks over the executors, hashes and answers go by shuffle."""
    row, stretch, schema = free_name(docs, "row_number"), free_name(docs, "stretch"), _result(docs)
    # stretches have to hold over reruns, so rows are written with them once
    keyed = materialise(_stretched(docs, text, row, stretch), "stretches")
    blocks = max(1, -(-n_lines // block_lines))
    hashes = map_arrow(keyed.select(text, stretch), _send(min_chars, blocks), _HASHES)
    answers = hashes.groupBy("block").applyInArrow(_answer(filter_bits(block_lines, bits_per_line)), _ANSWERS)
    texts = keyed.select(text, row, stretch)
    counts = materialise(answers.groupBy("stretch").cogroup(texts.groupBy(stretch)).applyInArrow(_count(text, row, min_chars), _COUNTS), "suspected-lines")
    keys = counts.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("row", "line")).alias("first")).where(F.col("n") >= min_docs)
    repeated = counts.select("stretch", "key", "hash").join(keys, "key").select("stretch", "key", "hash", "first.row", "first.line")
    return repeated.groupBy("stretch").cogroup(keyed.groupBy(stretch)).applyInArrow(_drop(text, row, stretch, schema.names, min_chars, keep), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), u AS (
  SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l
), k AS (
  SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM u
), bad AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON bad.key = k.key
GROUP BY k.r, k.doc_id
"""

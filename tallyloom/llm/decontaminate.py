"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased.  A window is ``n``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window.  A document
word inside any occurrence of a window is hit.

The benchmark is read in shards of about ``shard_bytes`` of text.  Each shard is broadcast and scanned for on its own: with
several, what the documents have met so far is written between two of them and the broadcast is given up, so that one is alive
at a time.  Nothing is shuffled.
Hash matches are verified on the bytes of the words.

Edge cases: null and empty texts have no words and are never contaminated; an item without words matches
nothing; repeated items count by their id; repeated documents are judged one by one; an empty benchmark
leaves every document clean; extra columns pass through, and the result columns replace columns of the same name, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .frames import discard, documents, free_name, map_arrow, materialise, quoted, set_aside, table, without

SHARD_BYTES = 32 << 20
FILTER_BITS = 22


@dataclass
class WindowIndex:
    """Windows of some items, by length: hashes in order, with one place of each, and the items that hold it."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def build_index(ids: list[str], texts: list[str | None], n: int) -> WindowIndex:
    data, offsets = ts.raw(pa.array(texts, pa.string()))
    chunk = ts.Chunk(0, ts.LOWER[data], offsets)
    spans = ts.words(chunk, ts.ALNUM)
    hashes = ts.span_hashes(chunk.data, spans.starts, spans.ends)
    counts = spans.counts()
    by_length = {}
    for length in sorted({int(min(n, c)) for c in counts if c}):
        whole = counts >= n if length == n else counts == length
        at = ts.expand(spans.bounds[:-1][whole], counts[whole] - length + 1)
        owner = np.repeat(np.flatnonzero(whole), counts[whole] - length + 1)
        h = ts.window_hashes(hashes, length)[at]
        order = np.argsort(h, kind="stable")
        h, at, owner = h[order], at[order], owner[order]
        unique, first, many = np.unique(h, return_index=True, return_counts=True)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[unique >> np.uint64(64 - FILTER_BITS)] = True
        by_length[length] = (unique, at[first], first, owner, bits)
    return WindowIndex(chunk.data, spans.starts, spans.ends, ids, by_length)


def find_windows(index: WindowIndex, chunk: ts.Chunk, spans: ts.Spans) -> tuple[np.ndarray, list[set[str]]]:
    """Of a chunk: which words are hit, and the items met in each document."""
    hit = np.zeros(len(spans) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(len(chunk))]
    hashes = ts.span_hashes(chunk.data, spans.starts, spans.ends)
    owner = None
    for length, (unique, place, first, holders, bits) in index.by_length.items():
        h = ts.window_hashes(hashes, length)
        at = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)])
        if len(at):
            at = at[ts.inner(spans.bounds, length, len(spans))[at]]
        if not len(at):
            continue
        k = np.minimum(np.searchsorted(unique, h[at]), len(unique) - 1)
        met = unique[k] == h[at]
        at, k = at[met], k[met]
        if not len(at):
            continue
        # verify: each pair of a document's word and an item's word once
        mine, theirs = ts.expand(at, np.full(len(at), length)), ts.expand(place[k], np.full(len(at), length))
        pairs, back = np.unique(mine * len(index.starts) + theirs, return_inverse=True)
        mine, theirs = pairs // len(index.starts), pairs % len(index.starts)
        same = ts.same_bytes(chunk.data, spans.starts[mine], spans.ends[mine], index.data, index.starts[theirs], index.ends[theirs])
        good = same[back].reshape(len(at), length).all(axis=1)
        at, k = at[good], k[good]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + length, -1)
        owner = spans.owner() if owner is None else owner
        last = np.append(first[1:], len(holders))
        for doc, w in np.unique(np.stack([owner[at], k]), axis=1).T:
            items[doc].update(index.ids[i] for i in holders[first[w] : last[w]])
    return np.cumsum(hit[:-1]) > 0, items


def _shards(benchmark: DataFrame, text: str, item_id: str, shard_bytes: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """How many shards are left, and the items of one of about ``shard_bytes``: one at a time on the driver."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    for k in range(shards):
        part = benchmark if shards == 1 else benchmark.where(F.pmod(F.xxhash64(item_id), F.lit(shards)) == k)
        rows = part.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text).toArrow()
        yield shards - 1 - k, rows.column(0).to_pylist(), rows.column(1).to_pylist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", benchmark_text: str = "text", n: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (longs), items (item ids met, sorted as strings) and spans (byte ranges of
    runs of hit words in the UTF-8 text)."""
    spark = docs.sparkSession
    docs = without(docs, {"n_words", "n_hit", "items", "spans"}, text)
    keep = [quoted(c) for c in docs.columns]
    state, written = free_name(docs, "hits"), None
    out = docs.withColumn(state, F.lit(None).cast("struct<n_words:bigint,spans:array<struct<from:bigint,to:bigint>>,words:array<struct<from:bigint,to:bigint>>,items:array<string>>"))
    schema = out.schema
    for left, ids, texts in _shards(benchmark, benchmark_text, item_id, shard_bytes):
        index = spark.sparkContext.broadcast(build_index(ids, texts, n))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, before = batch.column(batch.schema.get_field_index(text)), batch.column(batch.num_columns - 1)
                found: list[dict] = []
                earlier = before.to_pylist() if before.null_count < len(before) else None
                for chunk in ts.chunks(column):
                    spans = ts.words(chunk, ts.ALNUM)
                    hit, items = find_windows(index.value, chunk, spans)
                    for d in range(len(chunk)):
                        a, b = spans.bounds[d], spans.bounds[d + 1]
                        old = earlier[chunk.first + d] if earlier else None
                        mine = hit[a:b]
                        if old:
                            mine = mine.copy()
                            for w in old["words"]:
                                mine[w["from"] : w["to"]] = True
                        runs = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).reshape(-1, 2) if mine.any() else ()
                        shift = chunk.offsets[d]
                        found.append({
                            "n_words": int(b - a),
                            "spans": [{"from": int(spans.starts[a + x] - shift), "to": int(spans.ends[a + y - 1] - shift)} for x, y in runs],
                            "words": [{"from": int(x), "to": int(y)} for x, y in runs],
                            "items": sorted(items[d].union(old["items"] if old else ())),
                        })
                result = pa.array(found, batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], result], schema=batch.schema)

        out = map_arrow(out, scan, schema)
        if left:
            out = materialise(out, "hits")
            index.destroy()
            if written is not None:
                discard(written)
            written = out
    words = F.aggregate(f"{state}.words", F.lit(0).cast("long"), lambda total, w: total + w["to"] - w["from"])
    return out.select(*keep, F.col(f"{state}.n_words").alias("n_words"), words.alias("n_hit"), F.col(f"{state}.items").alias("items"), F.col(f"{state}.spans").alias("spans"))


def is_contaminated(share_of: int = 20) -> Column:
    """The contract's rule: any hit, and at least one word in ``share_of`` hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share_of >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "document", text: str = "text", share_of: int = 20, **options) -> DataFrame:
    """``docs`` without contaminated documents (``mode="document"``), or with the hit spans of contaminated documents
    cut out of their texts (``mode="span"``).  Columns stay as they are."""
    docs, back = set_aside(docs, {"n_words", "n_hit", "items", "spans"})
    found = find_contamination(docs, benchmark, text=text, **options)
    bad = is_contaminated(share_of)
    if mode == "document":
        clean = found.where(~bad)
    else:
        raw = F.encode(F.col(text), "utf-8")
        edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["to"]))
        upto = F.concat(F.transform("spans", lambda s: s["from"]), F.array(F.octet_length(raw).cast("long")))
        parts = F.zip_with(edges, upto, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
        clean = found.withColumn(text, F.when(bad, F.array_join(parts, "")).otherwise(F.col(text)))
    return clean.select(*back)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT DISTINCT item, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM (SELECT item, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0)
), m AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
), met AS (
  SELECT m.r, m.n, m.i, w.item FROM m JOIN w ON w.g = m.g AND w.n = m.n
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS place FROM met) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM met) GROUP BY r
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN items ON items.r = d.r
"""

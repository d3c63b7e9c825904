"""Importance resampling towards a target distribution, by hashed features.

Features are runs of 1 to ``max_n`` words, hashed to ``buckets`` counts.  Each task counts its documents into one array; the sums of corpus and
target give an array of gains, which is broadcast (``buckets`` numbers), and a document's weight is the sum of its features' gains.  With a
Gumbel-distributed number by id added, the highest scores are a draw without replacement by importance.

The draw looks for the key of the last document that is in, (score falling, doc_id rising), by radix selection: a digit of 16 bits is
counted among the rows that share the digits found, until a digit's rows are all in or all digits are known.  Rows up to that key alone are sorted by
ranges; the sizes of the ranges (a row for each) give the ranks.

Edge cases: a null or empty text has no words and no features, and weight 0; a document without an id gets a weight but no score and isn't drawn
from, nor counted among those; rows of one id and one score stand in the order of their other results, and of equal ones any may be in;
an empty target or corpus gives gains as by its formula; extra columns pass through ``resample``, and result columns replace
columns of the same name, whatever their case; words of any length are hashed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .frames import discard, documents, free_name, map_arrow, materialise, quoted, table, without

BUCKETS = 10_000
MAX_N = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bytes of a word that are hashed for all words together; longer words go on one by one.
SHORT = 48
DIGIT = 16
RESULT = ("n_words", "n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The crc32 of each span, or with ``before`` of what that is the crc32 of and the span after it."""
    state = ~(np.zeros(len(starts), np.uint32) if before is None else before)
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, SHORT), kind="stable")
    left = np.searchsorted(-sizes[order].clip(max=SHORT), -np.arange(min(SHORT, sizes.max(initial=0))), "left")
    for j, n in enumerate(left):  # how many words have a byte j
        i = order[:n]
        state[i] = CRC[(state[i] ^ data[starts[i] + j]) & 0xFF] ^ (state[i] >> 8)
    state = ~state
    for i in np.flatnonzero(sizes > SHORT):
        state[i] = zlib.crc32(data[starts[i] + SHORT : ends[i]], int(state[i]))
    return state


def features(chunk: ts.Chunk, spans: ts.Spans, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of each length: the documents that hold them and their crc32."""
    space, owner = np.array([32], np.uint8), spans.owner()
    state = crc32(chunk.data, spans.starts, spans.ends)
    yield owner, state
    first = np.arange(len(owner))
    for n in range(2, max_n + 1):
        more = first + n - 1 < len(owner)
        more[more] = owner[first[more]] == owner[first[more] + n - 1]
        first, state = first[more], state[more]
        zero, last = np.zeros(len(first), np.int64), first + n - 1
        state = crc32(chunk.data, spans.starts[last], spans.ends[last], crc32(space, zero, zero + 1, state))
        yield owner[first], state


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in ts.chunks(batch.column(0)):
                for _, crc in features(chunk, ts.words(chunk, ts.ALNUM), max_n):
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["bucket", "n"])

    parts = map_arrow(docs.select(F.col(text).cast("string").alias("text")), run, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ``buckets`` rows at most
    counts = np.zeros(buckets, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log of smoothed shares' ratio, floored."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, text: str = "text", max_n: int = MAX_N) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    held = without(docs, set(RESULT), text)
    whole = free_name(held, "_text")
    given = held.select("*", F.col(quoted(text)).cast("string").alias(whole))
    kept = [c for c in held.columns if c in without(docs, set(RESULT)).columns]
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, size, total = (np.zeros(len(column), np.int64) for _ in range(3))
            for chunk in ts.chunks(column):
                spans = ts.words(chunk, ts.ALNUM)
                rows = slice(chunk.first, chunk.first + len(chunk))
                n[rows] = spans.counts()
                for owner, crc in features(chunk, spans, max_n):
                    size[rows] += np.bincount(owner, minlength=len(chunk))
                    sums = np.concatenate([[0], np.cumsum(shared.value[crc % np.uint32(len(shared.value))])])
                    ends = np.searchsorted(owner, np.arange(len(chunk) + 1))
                    total[rows] += sums[ends[1:]] - sums[ends[:-1]]
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(size), pa.array(total)], names=["n_words", "n_features", "weight"])

    made = free_name(given, "_made")
    out = given.withColumn(made, weights(whole))
    return out.select(*map(quoted, kept), *(F.col(f"{made}.{c}").alias(c) for c in ("n_words", "n_features", "weight")))


def score(doc_id: str = "doc_id", weight: str = "weight", seed: int = SEED) -> Column:
    """Weight and a thousand times a Gumbel-distributed number by id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(quoted(doc_id)).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.col(weight) + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def last_key(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The ``k``-th of (score, id), scores falling and ids rising, by radix selection; a later key where a digit's rows are all in.

    ``keys`` are read once for each digit.
    """
    if k <= 0:
        return None
    # unsigned numbers that rise with the place of a row
    high, low = F.bitwise_not(F.col("score").bitwiseXOR(F.lit(-(1 << 63)))), F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    known, left = [0, 0], k
    for part, of in enumerate((high, low)):
        for shift in range(64 - DIGIT, -1, -DIGIT):
            up = shift + DIGIT
            same = (F.shiftrightunsigned(of, up) == (known[part] >> up)) if up < 64 else F.lit(True)
            if part:
                same &= high == _signed(known[0])
            digit = F.shiftrightunsigned(of, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counted = keys.where(same).groupBy(digit.alias("digit")).count().toArrow()  # 2**DIGIT rows at most
            digits, counts = counted.column(0).to_numpy(), counted.column(1).to_numpy()
            order = np.argsort(digits)
            upto = np.cumsum(counts[order])
            at = int(np.searchsorted(upto, left))
            left -= int(upto[at] - counts[order][at])
            known[part] |= int(digits[order][at]) << shift
            if left == counts[order][at]:  # all rows with these digits are in
                known[part] |= (1 << shift) - 1
                known[1] = known[1] if part else (1 << 64) - 1
                return _key(*known)
    return _key(*known)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _key(high: int, low: int) -> tuple[int, int]:
    return _signed(~high & ((1 << 64) - 1) ^ (1 << 63)), _signed(low ^ (1 << 63))


def _ranked(chosen: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``chosen`` sorted by ranges of ``order`` with the place of each row, from 1."""
    at = free_name(chosen, "_at")
    # the row's number spreads equal rows over ranges
    row = free_name(chosen, "_row")
    numbered = chosen.withColumn(row, F.monotonically_increasing_id())
    placed = materialise(numbered.repartitionByRange(*order, F.col(row)).sortWithinPartitions(*order, F.col(row)).drop(row).withColumn(at, F.monotonically_increasing_id()), "ranges")
    piece, within = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.piece: r.n for r in placed.groupBy(piece.alias("piece")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before, listed = 0, []
    for p in sorted(sizes):
        listed.append((p, before))
        before += sizes[p]
    starts = chosen.sparkSession.createDataFrame(listed, "piece long, before long").withColumnsRenamed({"piece": f"{at}_piece", "before": f"{at}_before"})
    joined = placed.join(F.broadcast(starts), piece == F.col(f"{at}_piece"))
    return joined.select(*map(quoted, chosen.columns), (F.col(f"{at}_before") + within + 1).alias(rank))


def _drawn_from(least_words: int) -> Column:
    return F.col("score").isNotNull() & (F.col("n_words") >= least_words)


def _threshold(scored: DataFrame, doc_id: str, percent: int, least_words: int) -> tuple[int, Column]:
    """How many are drawn, and which rows stand up to the last key: those, and rows of the last key that are too many."""
    able = scored.where(_drawn_from(least_words))
    k = able.count() * percent // 100
    key = last_key(able.select("score", F.col(quoted(doc_id)).cast("long").alias("id")), k)
    if key is None:
        return 0, F.lit(False)
    upto = (F.col("score") > key[0]) | ((F.col("score") == key[0]) & (F.col(quoted(doc_id)).cast("long") <= key[1]))
    return k, _drawn_from(least_words) & upto


def draw(scored: DataFrame, *, doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows of ``scored`` (with n_words, n_features, weight and score; read several times, so best a table) with rank, null if not drawn."""
    k, upto = _threshold(scored, doc_id, percent, least_words)
    ranked = _ranked(scored.where(upto), [F.desc("score"), F.asc(quoted(doc_id)), F.asc("n_features"), F.asc("n_words")], "rank")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.union(scored.where(~F.coalesce(upto, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with n_words, n_features, weight, score and rank.

    Weights are written with ids alone to find the last key; the drawn rows come from another scan.
    """
    gain = gains(bucket_counts(docs, text=text, buckets=buckets, max_n=max_n), bucket_counts(target, text=target_text, buckets=buckets, max_n=max_n))
    scored = weigh(docs, gain, text=text, max_n=max_n).withColumn("score", score(doc_id, seed=seed))
    keys = materialise(scored.select(quoted(doc_id), "n_words", "score"), "weights")
    k, upto = _threshold(keys, doc_id, percent, least_words)
    discard(keys)
    return _ranked(scored.where(upto), [F.desc("score"), F.asc(quoted(doc_id)), F.asc("n_features"), F.asc("n_words")], "rank").where(F.col("rank") <= k)


def op12(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark")))
    scored = materialise(weigh(docs, gain).select("doc_id", "n_words", "n_features", "weight").withColumn("score", score()), "weights")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH c AS MATERIALIZED (
  SELECT list(list_reduce([n] || range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS crc FROM range(256) t(n)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS MATERIALIZED (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS MATERIALIZED (
  SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY row, word
), bw AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word
), k AS MATERIALIZED (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
    lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), c
), s AS (SELECT bucket, sum(n)::BIGINT AS n FROM dw JOIN k USING (word) GROUP BY bucket
), t AS (SELECT bucket, sum(n)::BIGINT AS n FROM bw JOIN k USING (word) GROUP BY bucket
), g AS MATERIALIZED (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS MATERIALIZED (
  SELECT d.row, d.doc_id, coalesce(len(d.words), 0)::BIGINT AS n_features, coalesce(x.weight, 0)::BIGINT AS weight,
    ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h
  FROM d LEFT JOIN (SELECT row, sum(n * gain) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY row) x USING (row)
), r AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w
), o AS (
  SELECT *, CASE WHEN n_features >= 20 AND doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id, n_features) END AS place,
    10 * (count(*) FILTER (n_features >= 20 AND doc_id IS NOT NULL) OVER ()) // 100 AS k FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM o
"""

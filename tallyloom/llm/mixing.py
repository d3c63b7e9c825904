"""Mixing sources to target weights, in DataFrame operations only.

Sources share all words by weight; no source takes more than ``max_repeats`` times what it has, and what it
can't take goes to the others by weight.  The common level of that filling is the largest of
``(total - limits before) / weights left`` over sources in order of limit per weight.

Within a source documents stand in the order of a hash-random key.  Keys are cut into ranges of about
``bucket_rows`` documents, ranges into stretches of ``STRETCH``; prefix sums go over stretches, then over the ranges of the stretch
in which the budget ends, and only the range in which it ends is looked at row by
row.  So no task holds a whole source, and a document's decision needs its source's row alone: whole
epochs, then everything before the cut key, then the rest of the budget at the cut key.

Edge cases: a null text has size 0; the null source comes last in the order of weights; documents with one key (repeated
ids) that stand at the cut share what is left by size; empty sources have target 0; an empty table gives
an empty result; extra columns pass through, result columns replace columns of the same name, whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import discard, documents, free_name, materialise, quoted, without

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKET_ROWS = 4096
STRETCH = 1024
WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "taken")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with target; a row for each source."""
    listed = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.element_at(listed, F.pmod(F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1))
    limit = F.col("source_size") * max_repeats
    order = W.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = ranked.select("*", ((F.sum("source_size").over(everything) - before) / left).alias("level"))
    level = F.max("level").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return steps.select("source", "source_size", F.least(limit.cast("double"), level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words that the mix takes, repeats counted."""
    size = word_count(text) if size is None else size
    kept = [F.col(quoted(c)) for c in without(docs, set(RESULT)).columns]
    keyed = docs.select(F.col(source).alias("source"), size.alias("size"), random_key(doc_id).alias("key"))

    # what has a row for each source is written, so that its size is known and Spark joins it without moving documents where it is small
    rows = materialise(docs.groupBy(F.col(source).alias("source")).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("buckets")), "mix-sources")
    part = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(1 << 52)
    dealt = keyed.alias("k").join(rows.alias("r"), F.col("k.source").eqNullSafe(F.col("r.source"))).select("k.*", F.floor(part * F.col("buckets")).alias("bucket"))
    buckets = materialise(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-ranges")

    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    budget = F.floor("target")
    empty = F.col("source_size") == 0
    plan = materialise(
        sources.withColumn("epochs", F.when(empty, 0).otherwise(F.expr("floor(target) div source_size")).cast("long"))
        .withColumn("rest", F.when(empty, 0).otherwise(budget - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan",
    )

    def ends(sums: DataFrame, by: str, left: DataFrame) -> DataFrame:
        """(source, ``by``, left): where in the prefix sums of each source what is left of its budget ends, and what is left there."""
        upto = W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
        summed = sums.withColumn("upto", F.sum("words").over(upto))
        at = summed.alias("b").join(left.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).where((F.col("left") > F.col("upto") - F.col("words")) & (F.col("left") <= F.col("upto")))
        return at.select("b.source", by, (F.col("left") - F.col("upto") + F.col("words")).alias("left"))

    stretched = buckets.withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    last = ends(stretched.groupBy("source", "stretch").agg(F.sum("words").alias("words")), "stretch", plan.select("source", F.col("rest").alias("left")))
    within = stretched.alias("b").join(last.select("source", "stretch").alias("l"), F.col("b.source").eqNullSafe(F.col("l.source")) & (F.col("b.stretch") == F.col("l.stretch"))).select("b.source", "bucket", "words")
    ending = materialise(ends(within, "bucket", last), "mix-ends")
    near = dealt.alias("d").join(ending.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket"))).groupBy("d.source", "d.key").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = F.sum("words").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = near.withColumn("upto", run).where((F.col("left") > F.col("upto") - F.col("words")) & (F.col("left") <= F.col("upto"))).select("source", F.col("key").alias("cut"), (F.col("left") - F.col("upto") + F.col("words")).alias("cut_left"), F.col("words").alias("cut_words"))
    decided = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(F.struct("p.*", "cut", "cut_left", "cut_words").alias(name := free_name(docs, "mix")))

    own, key, of = size, random_key(doc_id), lambda c: F.col(f"{name}.{c}")
    rest = F.when(of("cut").isNull() | (key > of("cut")), F.lit(0)).when(key < of("cut"), own).otherwise(F.floor(own * of("cut_left") / of("cut_words")))
    taken = (own * of("epochs") + rest).cast("long")
    decided = materialise(decided, "mix-decided")
    for done in (rows, buckets, plan, ending):
        discard(done)
    joined = docs.join(decided, F.col(source).eqNullSafe(of("source")))
    return joined.select(*kept, own.alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), taken.alias("taken"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", word_count("text").alias("words"))
    mixed = mix(materialise(docs, "sizes"), size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS epochs FROM t
), g AS (
  SELECT source, key, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS before FROM d GROUP BY source, key
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * p.epochs + CASE
    WHEN p.source_size = 0 OR g.words = 0 THEN 0
    WHEN g.before + g.words <= floor(p.target)::BIGINT - p.epochs * p.source_size THEN d.size
    WHEN g.before >= floor(p.target)::BIGINT - p.epochs * p.source_size THEN 0
    ELSE floor(d.size * (floor(p.target)::BIGINT - p.epochs * p.source_size - g.before)::DOUBLE / g.words) END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.key = g.key
"""

"""Samples whose size is the feature: prefixes, seeded shuffles, quotas by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def seeded(key: str, seed: int = 42) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def prefix(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def shuffled_prefix(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(n)


def stratified(df: DataFrame, quotas: dict[str, int], *, key: str, category: str = "category", draw: Column | None = None) -> DataFrame:
    """Up to a quota of each category in random order, then the first others until the total is reached; ``drawn`` says which.

    One pass: each row stands for its category, in random order, and for all rows, in order of their keys, and tasks cut both to what
    can be needed before anything is shuffled.  At most ``total`` of the first ``2 * total`` rows are taken by quotas.
    """
    draw = seeded(key) if draw is None else draw
    total = sum(quotas.values())
    kind = df.select(draw.alias("draw")).schema["draw"].dataType
    stands = lambda own, of, place: F.struct(F.lit(own).alias("own"), of.cast("string").alias("of"), place.cast(kind).alias("draw"))
    kinds = F.array(stands(True, F.col(category), draw), stands(False, F.lit(None), F.lit(None)))
    each = df.withColumn("_as", F.explode(kinds)).select("*", F.col("_as.own").alias("_own"), F.col("_as.of").alias("_of"), F.col("_as.draw").alias("_draw")).drop("_as")
    ranked = each.withColumn("_rank", F.row_number().over(W.partitionBy("_own", "_of").orderBy("_draw", key))).where(F.col("_rank") <= 2 * total)
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("_of")], F.lit(0))
    others = [c for c in df.columns if c != key]
    met = ranked.groupBy(key).agg(
        F.any_value(F.struct(*others)).alias("_row"), F.max(F.col("_own") & (F.col("_rank") <= quota)).alias("_taken"), F.max(~F.col("_own")).alias("_early"),
    ).where("_taken or _early")
    drawn = F.when(F.col("_taken"), "quota").otherwise("backfill")
    rows = met.select(key, *(F.col(f"_row.{c}").alias(c) for c in others), drawn.alias("drawn"))
    return rows.orderBy(F.desc("drawn"), key).limit(total).select(*df.columns, "drawn")


#: Spec-derived: sizes of the three evaluation tiers, and the shares of their four strata.
TIERS = {"quick": 100, "diagnostic": 200, "promotion": 500}
MIX = (0.35, 0.20, 0.20, 0.25)


def tiered(df: DataFrame, tier: str, strata: list[str], **options) -> DataFrame:
    """Spec-derived: an evaluation set of one tier, by the mix of strata."""
    size = TIERS[tier]
    return stratified(df, {s: round(size * m) for s, m in zip(strata, MIX, strict=True)}, **options)

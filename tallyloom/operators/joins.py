"""Joins of records with lookups; Spark picks the strategy by the sides' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, *(F.col(f"_row.{c}") for c in others)).select(*df.columns)


def lookup(df: DataFrame, table: DataFrame, key: str, *, order: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Left join with the last row of each key; missing values take defaults."""
    last = keep_last(table, key, order).drop(order)
    joined = df.join(last, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def unfinished(problems: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Problems without a result yet."""
    return problems.join(done.select(key).distinct(), key, "left_anti")


def resumed(old: DataFrame, new: DataFrame) -> DataFrame:
    """All results after a restart: nothing that was finished before is lost."""
    return old.unionByName(new, allowMissingColumns=True)


def flag_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Is a row's key among the members?  No row is added or lost."""
    known = members.select(F.col(key)).distinct().withColumn(name, F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def first_present(*columns: Column, default: str = "") -> Column:
    """First candidate that is neither null nor empty; 0 and false count as present."""
    return F.coalesce(*(F.when(c.cast("string") != "", c.cast("string")) for c in columns), F.lit(default))


def first_true(*columns: Column, order: Column) -> Column:
    """First candidate that is neither null, empty nor 0, else ``row_`` and the row's number."""
    return F.coalesce(*(F.when(~c.cast("string").isin("", "0"), c.cast("string")) for c in columns), F.concat(F.lit("row_"), order.cast("string")))


def compare_runs(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Spec-derived: the same samples before and after a conversion; ids on one side only are labelled as drift."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    x, y = F.col("a.is_correct"), F.col("b.is_correct")
    label = F.when(x.isNull() | y.isNull(), "id_drift").when(x & y, "stable_pass").when(~x & ~y, "stable_fail").when(x, "regression").otherwise("improvement")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.col("a.pred_answer").alias("pre_answer"), F.col("b.pred_answer").alias("post_answer"), x.alias("pre_correct"), y.alias("post_correct"), label.alias("delta_label"))

"""Roll-ups, counts, priorities and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed


def share(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def rollup(df: DataFrame, *levels: str) -> DataFrame:
    """One row for all, one for each category, and so on down the levels; by grouping sets, in one shuffle.

    A group's split names its level; levels below it say ``ALL``.
    """
    sets = [tuple(levels[:k]) for k in range(len(levels) + 1)]
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in levels)).agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.count_if(F.coalesce(F.col("parse_success"), F.lit(False))).alias("n_parse_success"),
        F.bround(F.coalesce(F.avg("generation_token_count"), F.lit(0.0)), 1).alias("avg_generation_token_count"),
    )
    depth = {(1 << (len(levels) - k)) - 1: "overall" if k == 0 else levels[k - 1] for k in range(len(levels) + 1)}
    split = F.coalesce(*(F.when(F.col("_level") == level, F.lit(name)) for level, name in depth.items()))
    out = grouped.where("n > 0").select(
        split.alias("split"), *(F.when(F.col("_level").bitwiseAND(1 << (len(levels) - 1 - k)) > 0, "ALL").otherwise(F.col(c)).alias(c) for k, c in enumerate(levels)), "n", "correct",
        F.bround(share(F.col("correct"), F.col("n")), 4).alias("accuracy"), "n_parse_success", F.bround(share(F.col("n_parse_success"), F.col("n")), 4).alias("parse_success_rate"), "avg_generation_token_count",
    )
    return out


def failure_groups(df: DataFrame) -> DataFrame:
    """By category and subcategory: accuracy, mean log probabilities, and wrong or right answers of low confidence.

    ``min_logprob`` falls back to ``answer_min_logprob``; a wrong answer without either counts as confident.
    """
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    lp = F.coalesce("min_logprob", "answer_min_logprob")
    low = F.coalesce(lp < fixed.LOW_LOGPROB, F.lit(False))
    return df.groupBy("category", "subcategory").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("correct"), F.avg(lp).alias("_min"), F.avg("answer_min_logprob").alias("_answer"),
        F.count_if(~ok & low).alias("n_wrong_low_conf"), F.count_if(~ok & ~low).alias("n_wrong_high_conf"), F.count_if(ok & low).alias("n_correct_low_conf"),
    ).withColumn("_accuracy", share(F.col("correct"), F.col("n")))


def with_priority(groups: DataFrame) -> DataFrame:
    """Priority from 1 to 5 with its reasons, from unrounded accuracy; ranked by priority, then rounded accuracy."""
    n, accuracy, wrong = F.col("n"), F.col("_accuracy"), F.col("n") - F.col("correct")
    low = (wrong > 0) & (F.try_divide(F.col("n_wrong_low_conf").cast("double"), wrong.cast("double")) >= 0.5)
    solvable = F.col("category").isin(*fixed.SOLVER_VERIFIABLE)
    points = (
        F.when(n >= 100, 2).when(n >= 30, 1).otherwise(0) + F.when(accuracy < 0.70, 2).when(accuracy < 0.85, 1).otherwise(0)
        + F.when(low, 1).otherwise(0) + F.when(solvable, 1).otherwise(0)
    )
    reasons = F.concat_ws(
        "+", F.when(n >= 100, "high_volume").when(n >= 30, "moderate_volume"), F.when(accuracy < 0.70, "low_accuracy").when(accuracy < 0.85, "moderate_accuracy_gap"),
        F.when(low, "wrong_low_conf_concentrated"), F.when(solvable, "solver_verifiable"),
    )
    out = groups.select(
        "category", "subcategory", "n", "correct", F.bround(accuracy, 4).alias("accuracy"), F.bround("_min", 4).alias("avg_min_logprob"), F.bround("_answer", 4).alias("avg_answer_min_logprob"),
        "n_wrong_low_conf", "n_wrong_high_conf", "n_correct_low_conf", F.greatest(F.lit(1), F.least(F.lit(5), points)).alias("priority_score"), F.when(reasons == "", "no_clear_priority_signal").otherwise(reasons).alias("priority_reason"),
    )
    order = W.orderBy(F.desc("priority_score"), "accuracy", "category", "subcategory")
    return out.withColumn("rank", F.row_number().over(order))


def counts_with_share(df: DataFrame, *keys: str, within: str | None = None, share_name: str = "pct") -> DataFrame:
    """Value counts with their percentage of all rows, or of the rows of ``within``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(within) if within else W.partitionBy())
    return counted.withColumn(share_name, F.bround(100.0 * F.col("count") / F.greatest(total, F.lit(1)), 1))


def coverage(df: DataFrame) -> DataFrame:
    """Solved rows by category."""
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified")).withColumn("ratio", share(F.col("verified"), F.col("total")))


def label_counts(df: DataFrame, column: str, *, empty: str, order: str, most: int | None = None) -> DataFrame:
    """Counter of labels in order of frequency, ties by first occurrence; empty labels have a name.  ``most``: only the first."""
    label = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(empty)).alias(column)
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_first"))
    if most is not None:  # a top-k, which tasks cut
        counted = counted.orderBy(F.desc("count"), "_first").limit(most)
    return counted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "_first"))).drop("_first")


def top(df: DataFrame, k: int, *order: Column | str, by: str | None = None) -> DataFrame:
    """The first ``k`` rows (of each value of ``by``) with their rank."""
    if by is None:
        few = df.orderBy(*order).limit(k)
        return few.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def worst(groups: DataFrame, score: str, label: str, *ties: str) -> DataFrame:
    """The label with the least score; ties go to what comes first."""
    return groups.where(F.col(score).isNotNull()).agg(F.min(F.struct(score, *ties, label)).alias("m")).select(F.col(f"m.{label}").alias(label), F.col(f"m.{score}").alias(score))


def logprob_means(df: DataFrame) -> DataFrame:
    """Mean log probabilities and accuracy by category, of rows that have them."""
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    return df.where("min_logprob is not null").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("min_logprob").alias("avg_min_logprob"), F.avg("mean_logprob").alias("avg_mean_logprob"), (F.count_if(ok).cast("double") / F.count(F.lit(1))).alias("accuracy")
    )


def generation_health(df: DataFrame) -> DataFrame:
    """By finish reason: rows, outputs of at most one token, mean tokens."""
    tokens = F.col("generation_token_count")
    return df.groupBy("finish_reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(tokens <= 1).alias("n_short"), F.avg(tokens).alias("avg_tokens"))


def throughput(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(0.01))


def overall_row(summary: DataFrame, order: str) -> DataFrame:
    """The summary's overall row: the first that is marked so, else the first."""
    marked = (F.coalesce(F.col("split"), F.lit("")) == "overall") | (F.coalesce(F.col("category"), F.lit("")) == "ALL")
    return summary.orderBy(F.when(marked, 0).otherwise(1), order).limit(1)


def measured(df: DataFrame, split: str = "split") -> DataFrame:
    """Spec-derived: by split and category, passes, failures, errors of format and extraction, and the pass rate."""
    ok, parsed = F.coalesce(F.col("is_correct"), F.lit(False)), F.coalesce(F.col("parse_success"), F.lit(False))
    return df.groupBy(split, "category").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(ok).alias("pass_count"), F.count_if(parsed & ~ok).alias("fail_count"), F.count_if(~parsed).alias("error_count"),
        F.count_if(F.col("parse_error_type") == "empty_output").alias("format_failure_count"), F.count_if(F.col("parse_error_type") == "no_extractable_answer").alias("extraction_failure_count"),
    ).withColumn("pass_rate", share(F.col("pass_count"), F.col("sample_count")))

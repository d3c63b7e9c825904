"""Spec-derived: comparison of runs by category, promotion decisions, hold-out discipline, replay manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..sources.scratch import written
from . import bloom

#: Categories that the base model solves throughout, so that a miss is a regression.
EASY = ("cipher", "gravity", "numeral_conversion", "unit_conversion")
OPERATORS = ("xor_error", "and_error", "or_error", "shift_error", "mask_error", "hallucinated_rule")
POSITIONS = ("digit_order_error", "carry_error", "mapping_conflict", "leading_zero_error")


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_failure_modes(df: DataFrame, *, easy: tuple[str, ...] = EASY) -> DataFrame:
    """``df`` with failure_mode_primary and failure_mode_secondary: the first two labels of the taxonomy that hold; null for right answers.

    The taxonomy names the labels only; which column speaks for which is ours: parse errors and format errors first, then a
    regression by conversion (``delta_label``), operators, positions, the category's rule, easy categories, low
    confidence, and samples that only the diagnostic set got right (``diagnostic_correct``).  Missing columns speak for nothing.
    """
    parse, kind, category = F.coalesce(F.col("parse_error_type"), F.lit("")), F.coalesce(_or_null(df, "failure_type", "string"), F.lit("")), F.col("category")
    holds = [
        (parse.isin("empty_output", "truncated_no_boxed") | (kind == "answer_format_error"), "FORMAT_FAILURE"),
        ((parse == "no_extractable_answer") | (kind == "final_parse_error"), "EXTRACTION_FAILURE"),
        (_or_null(df, "delta_label", "string") == "regression", "PREPOST_CONVERSION_REGRESSION"),
        (kind.isin(*OPERATORS), "OPERATOR_CONFUSION"), (kind.isin(*POSITIONS), "POSITIONAL_MISMATCH"), (category == "bit_manipulation", "BIT_RULE_FAILURE"),
        (category.isin(*easy), "EASY_TASK_REGRESSION"), (_or_null(df, "min_logprob", "double") < fixed.LOW_LOGPROB, "LOW_LOGPROB_COLLAPSE"),
        (_or_null(df, "diagnostic_correct", "boolean"), "OVERFITTING_TO_DIAGNOSTIC"),
    ]
    assert {x for _, x in holds} | {"UNKNOWN"} == set(fixed.FAILURE_LABELS)
    met = F.filter(F.array(*(F.when(c, F.lit(x)) for c, x in holds)), lambda x: x.isNotNull())
    wrong = ~F.coalesce(F.col("is_correct"), F.lit(False))
    staged = df.withColumn("_met", F.when(wrong, met))
    primary = F.when(wrong, F.coalesce(F.get("_met", F.lit(0)), F.lit("UNKNOWN")))
    return staged.withColumns({"failure_mode_primary": primary, "failure_mode_secondary": F.get("_met", F.lit(1))}).drop("_met")


def manifest(modes: DataFrame, *, split: Column, key: str = "problem_id") -> DataFrame:
    """Category manifest of samples with failure modes, accuracy of their category and conversion label: eight fields.

    ``category_accuracy`` buckets difficulty; the reason of inclusion is the first of conversion, fragility and failure that holds.
    """
    bucket = F.when(F.col("category_accuracy") >= 0.85, "easy").when(F.col("category_accuracy") >= 0.70, "medium").otherwise("hard")
    sensitive = F.coalesce(F.col("delta_label").isin("regression", "improvement"), F.lit(False))
    brittle = F.coalesce(F.col("min_logprob") < fixed.LOW_LOGPROB, F.lit(False))
    reason = F.when(sensitive, "conversion_sensitive").when(brittle, "brittle").when(F.col("failure_mode_primary").isNotNull(), "failed").otherwise("coverage")
    return modes.select(F.col(key).alias("sample_id"), split.alias("split_name"), "category", bucket.alias("difficulty_bucket"), "failure_mode_primary", "failure_mode_secondary", sensitive.alias("conversion_sensitive_flag"), reason.alias("inclusion_reason"))


def measured_samples(scored: DataFrame, *, split: Column, key: str = "problem_id") -> DataFrame:
    """Measured rows of a baseline: nine fields."""
    parse = F.coalesce(F.col("parse_error_type"), F.lit(""))
    status = F.when(F.col("pred_answer").isNotNull(), "answered").otherwise("no_answer")
    runtime = F.when(F.col("finish_reason") == "length", "truncated").when(F.col("finish_reason") == "eos", "completed").otherwise("unknown")
    notes = F.concat_ws("; ", F.when(parse != "", parse), F.when(F.col("finish_reason") == "length", "hit the token limit"))
    return scored.select(
        F.col(key).alias("sample_id"), split.alias("split_name"), "category", status.alias("baseline_prediction_status"), F.col("is_correct").alias("baseline_correctness"),
        parse.isin("empty_output", "truncated_no_boxed").alias("format_failure_flag"), (parse == "no_extractable_answer").alias("extraction_failure_flag"), runtime.alias("runtime_status"), notes.alias("notes"),
    )


def fragile_samples(modes: DataFrame, *, split: Column, key: str = "problem_id") -> DataFrame:
    """Samples with their lowest token, its context on both sides and failure modes: eleven fields."""
    return modes.where("min_logprob is not null").select(
        F.col(key).alias("sample_id"), split.alias("split_name"), "category", F.col("is_correct").alias("correctness"), F.col("min_logprob").alias("min_logprob_value"), F.col("lowest_logprob_token").alias("min_logprob_token"),
        F.col("left_context").alias("local_context_left"), F.col("right_context").alias("local_context_right"), "failure_mode_primary", "failure_mode_secondary", _or_null(modes, "conversion_label", "string").alias("pre_or_post_conversion_label"),
    )


def conversion_deltas(before: DataFrame, after: DataFrame, *, split: Column, key: str = "problem_id") -> DataFrame:
    """The same samples before and after a conversion: eleven fields; a sample is brittle if either side's confidence is low."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    x, y = F.col("a.is_correct"), F.col("b.is_correct")
    label = F.when(x.isNull() | y.isNull(), "id_drift").when(x & y, "stable_pass").when(~x & ~y, "stable_fail").when(x, "regression").otherwise("improvement")
    result = lambda c: F.when(c, "pass").when(~c, "fail")
    bad = lambda c: F.when(F.col(f"{c}.{key}").isNotNull(), F.coalesce(F.col(f"{c}.parse_error_type"), F.lit("")).isin("empty_output", "truncated_no_boxed"))
    low = lambda c: F.coalesce(F.col(f"{c}.min_logprob") < fixed.LOW_LOGPROB, F.lit(False))
    named = joined.withColumn("_key", F.coalesce(f"a.{key}", f"b.{key}"))
    return named.select(
        F.col("_key").alias("sample_id"), split.alias("split_name"), F.coalesce("a.category", "b.category").alias("category"), result(x).alias("baseline_pre_conversion_result"), result(y).alias("baseline_post_conversion_result"),
        label.alias("delta_label"), bad("a").alias("format_failure_pre"), bad("b").alias("format_failure_post"), F.col("a.min_logprob").alias("min_logprob_pre"), F.col("b.min_logprob").alias("min_logprob_post"), (low("a") | low("b")).alias("brittle_subset_flag"),
    )


def compare_categories(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Accuracy of two summaries by category, with the difference; categories of one side only stay."""
    a, b = baseline.alias("a"), candidate.alias("b")
    joined = a.join(b, F.col("a.category") == F.col("b.category"), "full_outer")
    return joined.select(F.coalesce("a.category", "b.category").alias("category"), F.col("a.n").alias("baseline_n"), F.col("b.n").alias("candidate_n"), F.col("a.accuracy").alias("baseline_accuracy"), F.col("b.accuracy").alias("candidate_accuracy"), (F.col("b.accuracy") - F.col("a.accuracy")).alias("delta"))


def decide(compared: DataFrame, *, gain: float = 0.01, loss: float = -0.02, least: int = 30) -> DataFrame:
    """A status for each category; thresholds are parameters, as the policy gives no numbers."""
    n, delta = F.least("baseline_n", "candidate_n"), F.col("delta")
    status = F.when(delta.isNull(), "missing").when(n < least, "insufficient").when(delta <= loss, "reject").when(delta >= gain, "promote").otherwise("hold")
    return compared.withColumn("status", status)


def leaks(candidates: DataFrame, holdout: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows whose text is, up to case and white space, one of the hold-out's."""
    normal = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[\s]+", " "))
    known = holdout.select(F.sha2(normal(F.col(text)), 256).alias("_text")).distinct()
    return candidates.withColumn("_text", F.sha2(normal(F.col(text)), 256)).join(known, "_text", "left_semi").drop("_text")


def without_leaks(candidates: DataFrame, holdout: DataFrame, key: str, **options) -> DataFrame:
    return candidates.join(leaks(candidates, holdout, **options).select(key).distinct(), key, "left_anti")


def _grams(text: str, n: int):
    """Hashes of the words, and of these the distinct hashes of ``n`` in a row."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\s]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, n)))
    return words, F.when(F.size("_w") >= n, F.array_distinct(whole)).otherwise(F.array().cast("array<long>"))


def _each(df: DataFrame, grams: Column, *columns: str) -> DataFrame:
    """A row for each hash.  Outer, as of a plain ``explode`` the optimizer infers a filter that would make the grams anew for every word."""
    return df.select(*columns, F.explode_outer(grams).alias("_gram")).where(F.col("_gram").isNotNull())


def _with_grams(df: DataFrame, text: str, n: int, *columns: str) -> DataFrame:
    words, grams = _grams(text, n)
    return df.select(*columns, words.alias("_w")).select(*columns, grams.alias("_grams"))


def overlaps(candidates: DataFrame, holdout: DataFrame, key: str, *, text: str = "text", n: int = 13, least: float = 0.2, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(key, n_grams, n_shared): candidates of whose word ``n``-grams the hold-out has at least a share of ``least``.

    A Bloom filter of the hold-out's hashes goes to the candidates, which keep those that may be shared; a filter of these goes to the hold-out.
    So about as many rows are shuffled as grams are shared, with one more for each candidate.  Where the hold-out has more grams than a filter
    of ``max_bits`` tells apart (8 bits each), all are shuffled.
    """
    spark = candidates.sparkSession
    size = holdout.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(max_bits, bloom.bits_for(size // 6))  # words are of some six bytes with the space after them
    known = _with_grams(holdout, text, n)
    rows = _with_grams(candidates, text, n, key)
    if size // 6 * 8 > max_bits:
        known = _each(known, F.col("_grams"))
        kept = rows.select(key, F.size("_grams").cast("long").alias("n_grams"), "_grams")
    else:
        known = written(known)  # read twice
        filled = bloom.build(_each(known, F.col("_grams")), "_gram", bits)
        # of each candidate the number of grams and those that may be shared
        kept = written(rows.select(key, F.size("_grams").cast("long").alias("n_grams"), bloom.suspected(spark, filled, F.col("_grams")).alias("_grams")))
        back = bloom.build(_each(kept, F.col("_grams")), "_gram", bits)
        known = _each(known, bloom.suspected(spark, back, F.col("_grams")))
    shared = _each(kept, F.col("_grams"), key).join(known.distinct(), "_gram", "left_semi")
    none = F.lit(0).cast("long")
    counted = kept.select(key, "n_grams", none.alias("n_shared")).unionAll(shared.select(key, none.alias("n_grams"), F.lit(1).cast("long").alias("n_shared")))
    counted = counted.groupBy(key).agg(F.sum("n_grams").alias("n_grams"), F.sum("n_shared").alias("n_shared"))
    return counted.where((F.col("n_shared") > 0) & (F.col("n_shared") >= least * F.col("n_grams")))


def replay_weight(count: Column, total: Column, cap: float = 0.25) -> Column:
    """A group's share of a replay manifest, capped."""
    return F.least(count.cast("double") / total, F.lit(cap))


def replay_rows(rows: DataFrame, *, key: str = "problem_id", category: str = "category", score: str = "answer_min_logprob", size: int = 1000, cap: float = 0.25) -> DataFrame:
    """The rows of a replay set of at most ``size``, the least confident of each category first; no category has more than ``cap`` of it."""
    ranked = rows.withColumn("replay_rank", F.row_number().over(W.partitionBy(category).orderBy(score, key))).where(F.col("replay_rank") <= int(size * cap))
    return ranked.orderBy("replay_rank", category, key).limit(size)

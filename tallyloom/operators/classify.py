"""Ordered rule classifiers over problem texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.matching import fold, occurs, occurs_in, words_of
from ..functions.text import any_of, found, let

KEYWORDS = [*(p for ps in fixed.CATEGORY_PATTERNS.values() for p in ps), *(p for rules in fixed.SUBCATEGORY_PATTERNS.values() for _, p in rules)]


def first_pattern(folded: Column, words: Column, patterns: list[str]) -> Column:
    """The first pattern that occurs, as text; null if none does."""
    return F.coalesce(*(F.when(occurs(folded, words, p), F.lit(p)) for p in patterns))


def subcategory(category: Column, folded: Column, words: Column) -> Column:
    """First matching rule of the category; ``unknown`` without a match, ``n/a`` for categories without rules."""
    out = F.when(F.lit(False), F.lit(""))
    for name, rules in fixed.SUBCATEGORY_PATTERNS.items():
        out = out.when(category == name, F.coalesce(*(F.when(occurs(folded, words, p), F.lit(s)) for s, p in rules), F.lit("unknown")))
    return out.otherwise(F.when(category == "other", "unknown").otherwise("n/a"))


def hits(folded: Column, words: Column) -> Column:
    """Categories that match, in order, each with its first pattern: array of (category, pattern)."""
    each = []
    for name, patterns in fixed.CATEGORY_PATTERNS.items():
        p = first_pattern(folded, words, patterns)
        each.append(F.struct(F.lit(name).alias("category"), p.alias("pattern")))
    return F.filter(F.array(*each), lambda x: x["pattern"].isNotNull())


def combined_text(label: Column, question: Column, examples: Column) -> Column:
    return F.concat(label, F.lit(" "), F.trim(F.coalesce(question, F.lit(""))), F.lit(" "), F.coalesce(examples, F.lit("")))


def by_keywords(df, *, category: Column, question: Column, examples: Column):
    """``df`` with c1: (category, subcategory, confidence, rule, matched_keywords, manual_review_required).

    An explicit label wins; else the first category in order of priority, with less confidence the more of them match.  Each text is folded
    and split into words once.
    """
    label = F.trim(F.lower(F.coalesce(category, F.lit(""))))
    staged = df.withColumns({"_label": label, "_text": fold(combined_text(label, question, examples))})
    staged = staged.withColumn("_words", words_of(F.col("_text"), KEYWORDS)).withColumn("_hits", hits(F.col("_text"), F.col("_words")))
    explicit, n = F.col("_label").isin(*fixed.CRYPTARITHM_LABELS), F.size("_hits")
    chosen = F.when(explicit, "cryptarithm").when(n == 0, "other").otherwise(F.get("_hits", F.lit(0))["category"])
    staged = staged.withColumn("_category", chosen)
    result = F.struct(
        F.col("_category").alias("category"),
        subcategory(F.col("_category"), F.col("_text"), F.col("_words")).alias("subcategory"),
        F.when(explicit, "high").when(n.isin(1, 2), "medium").otherwise("low").alias("confidence"),
        F.when(explicit, "explicit_category_field").when(n == 0, "no_match_fallback").when(n == 1, "single_keyword_match").otherwise("multi_keyword_priority").alias("rule"),
        F.when(explicit, F.col("_label")).otherwise(F.array_join(F.transform("_hits", lambda x: x["pattern"]), "|")).alias("matched_keywords"),
        (~explicit & ((n == 0) | (n >= 3))).alias("manual_review_required"),
    )
    return staged.withColumn("c1", result).drop("_label", "_text", "_words", "_hits", "_category")


def labelled_set(classified, *, key: str = "problem_id", question: str = "question", gold: str = "gold_answer"):
    """The second projection of classified rows: their labels with at most 300 characters of the question, and the gold answer."""
    c1 = [F.col(f"c1.{c}").alias(c) for c in ("category", "subcategory", "confidence", "manual_review_required")]
    return classified.select(key, *c1, F.substring(question, 1, 300).alias("question"), gold)


def by_single_pattern(text: Column) -> Column:
    """First of six patterns, else ``other``."""
    return let(F.lower(text), lambda low: F.coalesce(*(F.when(occurs_in(text, low, p), F.lit(name)) for name, p in fixed.SINGLE_PATTERNS), F.lit("other")))


def by_phrases(question: Column) -> Column:
    """Struct (category, subcategory) from phrases and patterns."""
    question = F.coalesce(question, F.lit(""))
    low = F.lower(question)
    words = found(question, fixed.WORD_SUM, ignore_case=False)
    row = lambda c, s: F.struct(F.lit(c).alias("category"), (s if isinstance(s, Column) else F.lit(s)).alias("subcategory"))
    return (
        F.when(any_of(low, fixed.LETTER_PHRASES), row("cryptarithmetic", F.when(words, "word_arithmetic").otherwise("digit_assignment")))
        .when(words & any_of(low, fixed.LETTER_HINTS), row("cryptarithmetic", "word_arithmetic"))
        .when(any_of(low, fixed.BIT_PHRASES), row("bit_manipulation", F.when(found(question, fixed.BITS_ARROW), "pattern_discovery").otherwise("single_operation")))
        .when(found(question, fixed.BITS_TO_BITS), row("bit_manipulation", "pattern_discovery"))
        .when(any_of(low, fixed.NUMERAL_PHRASES), row("numeral_conversion", F.when(F.contains(low, F.lit("hex")), "hex_decimal").when(F.contains(low, F.lit("oct")), "octal_decimal").otherwise("cross_base")))
        .otherwise(row("other", "unknown"))
    )

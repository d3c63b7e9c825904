"""Failure classifiers: ordered cascades of labels with reasons, and priorities of examples."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_fold, found

BOX = r"\\boxed\{"
WHY = fixed.REASONS


def cascade(*rows: tuple[Column, str, str]) -> Column:
    """Struct (failure_type, failure_reason) of the first row whose condition holds."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("failure_type"), F.lit("").alias("failure_reason")))
    for condition, label, reason in rows:
        out = out.when(condition, F.struct(F.lit(label).alias("failure_type"), F.lit(reason).alias("failure_reason")))
    return out


def _columns() -> tuple[Column, Column, Column, Column, Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return text("raw_output"), text("gold_answer"), text("pred_answer"), F.coalesce(F.col("subcategory"), F.lit("unknown")), F.coalesce(F.col("is_correct"), F.lit(False))


def same_upper(pred: Column, gold: Column) -> Column:
    return (pred != "") & (F.upper(pred) == F.upper(gold))


def mapping_conflict(raw: Column) -> Column:
    """Some letter has two digits or some digit two letters: more distinct pairs than letters, or than digits."""
    pattern = F.lit(fixed.LETTER_DIGIT)
    letters, digits = F.regexp_extract_all(raw, pattern, 1), F.regexp_extract_all(raw, pattern, 2)
    pairs = F.size(F.array_distinct(F.zip_with(letters, digits, lambda a, b: F.concat(a, b))))
    return (pairs > F.size(F.array_distinct(letters))) | (pairs > F.size(F.array_distinct(digits)))


def leading_zero(raw: Column) -> Column:
    letter = F.regexp_extract(raw, fixed.LETTER_ZERO, 1)
    return (letter != "") & F.regexp_like(raw, F.concat(F.lit(r"\b"), letter, F.lit(r"[A-Z]+\s*[=+\-]")))


def attempts(raw: Column) -> Column:
    return sum((F.regexp_count(raw, F.lit("(?id)" + p)) for p in fixed.ATTEMPTS), F.lit(0))


def any_found(raw: Column, *patterns: str, ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | found(raw, p, ignore_case)
    return out


def cryptarithm() -> Column:
    raw, gold, pred, _, ok = _columns()
    said = ~same_upper(pred, gold) & contains_fold(raw, gold)
    return cascade(
        (ok, "fragile_correct", WHY["fragile"]),
        (said, "final_parse_error", WHY["said_letters"]),
        (said & ~found(raw, BOX, False), "answer_format_error", WHY["format_letters"]),
        (mapping_conflict(raw), "mapping_conflict", WHY["conflict"]),
        (leading_zero(raw), "leading_zero_error", WHY["leading_zero"]),
        (any_found(raw, *fixed.INVENTED_RULES), "hallucinated_rule", WHY["invented"]),
        (any_found(raw, *fixed.CARRIES), "carry_error", WHY["carry"]),
        (attempts(raw).between(1, 2), "incomplete_search", WHY["few_attempts"]),
        (any_found(raw, *fixed.CALCULATIONS, ignore_case=False), "arithmetic_error", WHY["arithmetic"]),
        (F.lit(True), "unknown", WHY["unknown"]),
    )


def _format_rows(raw: Column, gold: Column, pred: Column, ok: Column) -> list[tuple[Column, str, str]]:
    said = contains_fold(raw, gold)
    return [
        (ok, "unknown", WHY["unknown"]),
        (said & ~found(raw, BOX, False), "answer_format_error", WHY["format"]),
        (said & (pred == ""), "final_parse_error", WHY["said"]),
    ]


def bit() -> Column:
    raw, gold, pred, sub, ok = _columns()
    xor, either = found(raw, r"\bXOR\b", False), found(raw, r"\bAND\b|\bOR\b", False)
    rows = _format_rows(raw, gold, pred, ok)
    rows += [((sub == "xor") & either & ~xor, "xor_error", WHY["not_xor"]), (sub == "xor", "xor_error", WHY["xor"])]
    for name in ("and", "or"):
        rows += [((sub == name) & xor, f"{name}_error", WHY["wrong_operator"].format(name.upper())), (sub == name, f"{name}_error", WHY["operator"].format(name.upper()))]
    shift = sub.isin("shift_left", "shift_right")
    rows += [
        (shift & found(raw, "shift"), "shift_error", WHY["shift_said"]), (shift, "shift_error", WHY["shift"]), (sub == "mask", "mask_error", WHY["mask"]),
        ((sub == "signed_unsigned") & found(raw, r"two.?s complement|negative"), "signed_unsigned_error", WHY["sign_said"]), (sub == "signed_unsigned", "signed_unsigned_error", WHY["sign"]),
        (sub == "binary_arithmetic", "arithmetic_error", WHY["binary_arithmetic"]), (found(raw, r"0b[01]+|binary"), "base_conversion_error", WHY["base"]),
        (F.lit(True), "unknown", WHY["unknown"]),
    ]
    return cascade(*rows)


def digits_swapped(pred: Column, gold: Column) -> Column:
    """Both given, and the same hexadecimal digits in whatever order (none at all counts as the same)."""
    digits = lambda c: F.array_sort(F.split(F.regexp_replace(F.upper(c), r"[^0-9a-fA-F]", ""), ""))
    return (pred != "") & (gold != "") & (digits(pred) == digits(gold))


def numeral() -> Column:
    raw, gold, pred, sub, ok = _columns()
    rows = [*_format_rows(raw, gold, pred, ok), (digits_swapped(pred, gold), "digit_order_error", WHY["digit_order"])]
    rows += [(sub == name, label, reason) for (name, label), reason in zip(fixed.NUMERAL_LABELS.items(), fixed.NUMERAL_REASONS, strict=True)]
    rows += [
        (found(raw, fixed.BINARY_SEEN, False), "binary_decimal_error", WHY["binary_seen"]), (found(raw, fixed.HEX_SEEN, False), "hex_decimal_error", WHY["hex_seen"]),
        (F.lit(True), "unknown", WHY["unknown"]),
    ]
    return cascade(*rows)


def notebook(df: DataFrame) -> DataFrame:
    """``df`` with failure_type of the notebook's cascade; categories carry the third classifier's names."""
    raw, _, _, _, ok = _columns()
    cat, boxed = F.col("category"), found(raw, BOX, False)
    parsed = F.coalesce(F.col("parse_success"), F.lit(False))
    said = fixed.NOTEBOOK_LABELS
    letters, bits, numbers = cat == "cryptarithmetic", cat == "bit_manipulation", cat == "numeral_conversion"
    return df.withColumn("failure_type", (
        F.when(ok, said["right"]).when(~parsed, said["unparsed"]).when(F.col("finish_reason") == "length", said["cut"])
        .when(letters & found(raw, fixed.LETTERS_ASSIGNED, False), said["letters"]).when(letters & boxed, said["boxed"]).when(letters, said["no_letters"])
        .when(bits & found(raw, fixed.BITS_SEEN, False), said["bits"]).when(bits & boxed, said["boxed"]).when(bits, said["no_bits"])
        .when(numbers & boxed, said["number"]).when(numbers, said["no_number"]).otherwise(said["other"])
    ))


def lookup(value: Column, known: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def boosted(base: Column, answer_min: Column) -> Column:
    return F.when(F.coalesce(answer_min < fixed.BOOST_LOGPROB, F.lit(False)), F.least(F.lit(5), base + 1)).otherwise(base)


def cryptarithm_priority(kind: Column, solver: Column, synthetic: Column, answer_min: Column) -> Column:
    base = (
        F.when(kind.isin("mapping_conflict", "carry_error", "leading_zero_error"), F.when(solver, 5).otherwise(4)).when(kind.isin("incomplete_search", "constraint_missed"), F.when(synthetic, 4).otherwise(3))
        .when(kind == "final_parse_error", 4).when(kind == "answer_format_error", 5).when(kind == "hallucinated_rule", 3).when(kind == "arithmetic_error", F.when(solver, 3).otherwise(2)).when(kind == "fragile_correct", 3).otherwise(2)
    )
    return boosted(base, answer_min)


def bit_numeral_priority(kind: Column, category: Column, solver: Column, synthetic: Column, answer_min: Column) -> Column:
    high = ((category == "bit_manipulation") & kind.isin(*fixed.HIGH_VALUE_BIT)) | ((category == "numeral_conversion") & kind.isin(*fixed.HIGH_VALUE_NUMERAL))
    base = F.when(high, F.when(solver, 5).otherwise(4)).when(kind.isin("answer_format_error", "final_parse_error", "digit_order_error", "mask_error"), 4).when(kind == "unknown", 2).otherwise(3)
    return boosted(F.when(synthetic, F.least(F.lit(5), base + 1)).otherwise(base), answer_min)


#: Each process: classifier, template table with default, and how its flags follow from the row.
PROCESSES = {
    "cryptarithm": (cryptarithm, fixed.CRYPTARITHM_TEMPLATES, fixed.CRYPTARITHM_DEFAULT_TEMPLATE),
    "bit_manipulation": (bit, fixed.BIT_TEMPLATES, fixed.BIT_DEFAULT_TEMPLATE),
    "numeral_conversion": (numeral, fixed.NUMERAL_TEMPLATES, fixed.NUMERAL_DEFAULT_TEMPLATE),
}


def _by_category(of: Callable[[str], Column]) -> Column:
    first, *rest = PROCESSES
    out = F.when(F.col("category") == first, of(first))
    for c in rest:
        out = out.when(F.col("category") == c, of(c))
    return out


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with failure_type and failure_reason by the cascade of their category; null for other categories."""
    return rows.withColumn("failure", _by_category(lambda c: PROCESSES[c][0]())).select("*", "failure.*").drop("failure")


def all_cases(joined: DataFrame, *, order: str, categories: Iterable[str] = tuple(PROCESSES), fragile: Iterable[str] = ("cryptarithm",)) -> DataFrame:
    """Failure cases in one pass over the rows: wrong answers (and in ``fragile`` categories right ones of low confidence),
    labelled, with template and priority."""
    ok, answer_min = F.coalesce(F.col("is_correct"), F.lit(False)), F.col("answer_min_logprob")
    shaky = F.col("category").isin(*fragile) & ok & F.coalesce(answer_min < fixed.LOW_LOGPROB, F.lit(False))
    rows = labelled(joined.where(F.col("category").isin(*categories) & (~ok | shaky)))
    kind, sub, letters = F.col("failure_type"), F.coalesce(F.col("subcategory"), F.lit("unknown")), F.col("category") == "cryptarithm"
    solver = F.when(letters, sub.isin(*fixed.SOLVABLE_LETTERS)).when(F.col("category") == "numeral_conversion", F.lit(True)).otherwise(sub.isin(*fixed.SOLVABLE_BITS))
    synthetic = F.when(letters, kind.isin(*fixed.SYNTHETIC_LETTERS)).otherwise(kind != "unknown")
    staged = rows.withColumns({"solver_check_possible": solver, "synthetic_generation_possible": synthetic, "recommended_template": _by_category(lambda c: lookup(kind, *PROCESSES[c][1:]))})
    flags = F.col("solver_check_possible"), F.col("synthetic_generation_possible")
    priority = F.when(letters, cryptarithm_priority(kind, *flags, answer_min)).otherwise(bit_numeral_priority(kind, F.col("category"), *flags, answer_min))
    return staged.select(
        "problem_id", "category", "subcategory", F.substring("question", 1, 300).alias("question"), "gold_answer", "pred_answer", "is_correct", "min_logprob", "answer_min_logprob", "failure_type", "failure_reason",
        "solver_check_possible", "synthetic_generation_possible", "recommended_template", priority.alias("example_priority"), *([] if order == "problem_id" else [F.col(order)]),
    )


def cases(joined: DataFrame, category: str, *, order: str, include_fragile: bool = False) -> DataFrame:
    """Failure cases of one category."""
    return all_cases(joined, order=order, categories=(category,), fragile=(category,) if include_fragile else ())


def in_order(rows: DataFrame, order: str) -> DataFrame:
    """Failure cases as reports list them: by priority, then label, then input order; a range sort, not one task."""
    return rows.orderBy(F.desc("example_priority"), "failure_type", order)

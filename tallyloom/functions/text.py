"""Text operators as column expressions: extraction, normalisation, parsing, classification helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Python's ``str.strip`` without arguments, for the white space that texts hold.
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def found(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Does the pattern occur?  A dot stops at line feeds only."""
    return c.rlike(("(?id)" if ignore_case else "(?d)") + pattern)


def group(c: Column, pattern: str, number: int = 1, flags: str = "(?d)") -> Column:
    """A group of the first match, null without a match."""
    return F.when(c.rlike(flags + pattern), F.regexp_extract(c, flags + pattern, number))


def filled(template: str, *parts: Column) -> Column:
    """The text with its ``%s`` replaced in order; null if one of them is."""
    first, *rest = template.split("%s")
    return F.concat(F.lit(first), *(x for part, after in zip(parts, rest, strict=True) for x in (part, F.lit(after))))


def contains_fold(c: Column, part: Column) -> Column:
    """Literal occurrence without regard to case; never for an empty part."""
    return F.coalesce((F.length(part) > 0) & F.contains(F.lower(c), F.lower(part)), F.lit(False))


def any_of(c: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9]", "")


def before(c: Column, pattern: str, flags: str) -> Column:
    """What stands before the first match."""
    return F.substring(c, F.lit(1), F.regexp_instr(c, F.lit(flags + pattern)) - 1)


def extract_answer(raw: Column, truncated: Column | None = None) -> Column:
    """Struct (pred_answer, reasoning_text, final_answer_text): a boxed answer, else one after a phrase, else the last
    line of a text that isn't truncated."""
    boxed, phrase_flags = "(?sd)", "(?id)"
    raw = F.coalesce(raw, F.lit(""))
    has_box = raw.rlike(boxed + fixed.BOXED)
    phrase = alphanumeric(F.regexp_extract(raw, phrase_flags + fixed.PHRASE, 1))
    lines = F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    last = F.element_at(lines, -1)
    use_last = (F.size(lines) > 0) & last.rlike("(?d)" + fixed.LAST_LINE)
    if truncated is not None:
        use_last = use_last & ~F.coalesce(truncated, F.lit(False))
    row = lambda answer, reasoning, text: F.struct(answer.alias("pred_answer"), reasoning.alias("reasoning_text"), text.alias("final_answer_text"))
    nothing = F.lit(None).cast("string")
    return (
        F.when(has_box, row(strip(F.regexp_extract(raw, boxed + fixed.BOXED, 1)), strip(before(raw, fixed.BOXED, boxed)), F.regexp_extract(raw, boxed + fixed.BOXED, 0)))
        .when(phrase != "", row(phrase, strip(before(raw, fixed.PHRASE, phrase_flags)), F.regexp_extract(raw, phrase_flags + fixed.PHRASE, 0)))
        .when(use_last, row(strip(F.regexp_extract(last, "(?d)" + fixed.LAST_LINE, 0)), F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), last))
        .otherwise(row(nothing, strip(raw), nothing))
    )


def normalize_answer(answer: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(answer, F.lit("")), r"[\s\x1c-\x1f\x85\xa0]+", ""))


def answers_match(pred: Column, gold: Column) -> Column:
    return (F.coalesce(pred, F.lit("")) != "") & (normalize_answer(pred) == normalize_answer(gold))


def parse_error_type(pred: Column, raw: Column, truncated: Column | None = None) -> Column:
    raw = F.coalesce(raw, F.lit(""))
    out = F.when(pred.isNotNull(), F.lit(None).cast("string"))
    if truncated is not None:
        out = out.when(F.coalesce(truncated, F.lit(False)), "truncated_no_boxed")
    return out.when(raw.rlike("(?sd)" + fixed.BOXED), "boxed_found_but_empty").when(F.length(strip(raw)) < 10, "empty_output").otherwise("no_extractable_answer")


def clean_answer(text: Column) -> Column:
    """Boxed, else stated, else quoted at the end, else all; letters and digits only."""
    text = strip(F.coalesce(text, F.lit("")))
    chosen = F.coalesce(group(text, fixed.BOXED), group(text, fixed.STATED, flags="(?id)"), group(text, fixed.QUOTED), text)
    return alphanumeric(chosen)


#: ``fixed.EXPRESSION`` without steps back: a match starts where letters and digits start, and no part can give up what the next would take.
_EXPRESSION = "(?<![A-Za-z0-9])" + fixed.EXPRESSION.replace("]+", "]++").replace(r"\s*", r"\s*+").replace("}", "}+")


def parse_expression(text: Column) -> Column:
    """Struct (left, op, right) of the first expression, or null."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract(text, _EXPRESSION, k).alias(n) for k, n in ((1, "left"), (2, "op"), (3, "right"))]
    return F.when(text.rlike(_EXPRESSION), F.struct(*parts))


def operator_symbols(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_EXPRESSION), 2)
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def finish_reason(tokens: Column, last_is_end: Column, limit: Column) -> Column:
    """How generation ended: at an end token, at the limit, or unknown."""
    return F.when(tokens.isNull(), "unknown").when(last_is_end, "eos").when(tokens >= limit, "length").otherwise("unknown")


def report_number(value: Column, default: float = 0.0) -> Column:
    """A number out of report text; marks of estimates and placeholders fall away."""
    plain = F.replace(F.replace(value.cast("string"), F.lit("ESTIMATED_"), F.lit("")), F.lit("PLACEHOLDER"), F.lit(str(default)))
    return F.coalesce(plain.try_cast("double"), F.lit(default))


def metric_match(pred: Column, gold: Column, tolerance: float = fixed.METRIC_TOLERANCE) -> Column:
    """Competition metric: numbers agree within an absolute tolerance, other answers exactly after clean-up of markup.  Spec-derived."""
    clean = lambda c: strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\(?:text|mathrm)\{([^{}]*)\}", "$1"), r"[$]|\\[,;! ]", ""))
    a, b = clean(pred), clean(gold)
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a == "", F.lit(False)).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(a == b)


def prompt(question: Column, examples: Column) -> Column:
    """The problem as a prompt; ``examples`` is an array of (input, output) structs or null."""
    shown = F.transform(examples, lambda e, i: filled(fixed.PROMPT_EXAMPLE, (i + 1).cast("string"), F.coalesce(e["input"], F.lit("")), F.coalesce(e["output"], F.lit(""))))
    given = F.size(F.coalesce(examples, F.array().cast("array<struct<input:string,output:string>>"))) > 0
    block = F.when(given, filled(fixed.PROMPT_EXAMPLES, F.array_join(shown, "\n"))).otherwise("")
    return filled(fixed.PROMPT, block, strip(F.coalesce(question, F.lit(""))))


def length_summary(question: Column, examples: Column, answer: Column) -> Column:
    n = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("string")
    return F.concat(F.lit('{"answer_chars": '), n(answer), F.lit(', "examples_chars": '), n(examples), F.lit(', "question_chars": '), n(question), F.lit("}"))


#: A JSON string, and what stands around a float that doesn't occur in texts.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MARK = "\ue000\ue001"
_WHOLE = r"-?[0-9]++(?![0-9.eE])"
#: Floats, and whole numbers that VARIANT wouldn't give back as they are.
_FLOAT = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_ODD = r"-0(?![0-9.eE])|-?[0-9]{30,}+(?![.eE])"


def _float(token: Column) -> Column:
    """A number as Python writes it: the shortest digits, with an exponent from 1e16 and below 1e-4."""
    value = token.try_cast("double")
    plain = value.cast("string")
    fixed_ = F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    power = F.substring_index(plain, "E", -1).try_cast("int")
    digits = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    scientific = F.concat(F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), digits)
    return (
        F.when(~token.rlike("[.eE]"), F.when(token == "-0", "0").otherwise(token)).when(value == 0, F.when(F.startswith(token, F.lit("-")), "-0.0").otherwise("0.0"))
        .when(F.abs(value) == float("inf"), F.regexp_replace(plain, r"\+", "")).when((F.abs(value) >= 1e16) | (F.abs(value) < 1e-4), scientific)
        .otherwise(F.concat(fixed_, F.when(F.endswith(fixed_, F.lit(".")), "0").otherwise("")))
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used and wherever filters are pushed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_value(c: Column) -> Column:
    """The text as a VARIANT; null if it isn't one JSON value with nothing after it, which parsers let pass: a mark behind it tells."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{_MARK}"]')))
    return let(listed, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == _MARK, F.try_variant_get(v, "$[0]", "variant")))


def canonical_json(raw: Column) -> Column:
    """JSON with its keys in order at every depth, a space behind ``,`` and ``:``; what isn't JSON stays as it is, null and empty texts are empty.

    A VARIANT puts the keys in order.  It would not give floats back as they were, so they pass through it as marked strings.  An object that names
    a key twice, NaN and Infinity aren't JSON here.
    """
    token = rf"\G((?:{_STRING}|[^\"0-9-]++|(?!{_ODD}){_WHOLE})*+)({_ODD}|{_FLOAT})"

    def marked(raw: Column) -> Column:
        """What is no JSON stays so, as a mark stands for a whole number alone; but for a number as a key, which ``whole`` looks for."""
        return F.regexp_replace(raw, token, f'$1"{_MARK}$2"')

    def parsed(marked: Column) -> Column:
        """In a list, as a text alone would come back without its quotes."""
        return F.try_parse_json(F.concat(F.lit("["), marked, F.lit("]"))).cast("string")

    def whole(marked: Column, made: Column) -> Column:
        """One value and nothing after it: but for white space, keys' order and how strings are written both are of one length."""
        bones = lambda c: F.length(F.regexp_replace(F.regexp_replace(c, _STRING, '""'), r"[ \t\n\r]+", ""))
        key = F.contains(made, F.lit(_MARK)) & made.rlike(f'"{_MARK}[^"]*+":')
        return F.coalesce((F.json_array_length(made) == 1) & (bones(marked) + 2 == bones(made)) & ~key, F.lit(False))

    def escaped(top: Column) -> Column:
        """Escapes in lower case."""
        low = top
        for code in ("0b", "0e", "0f", "1a", "1b", "1c", "1d", "1e", "1f"):
            low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*+)\\u00{code.upper()}", rf"$1\\u00{code}")
        return F.when(F.contains(top, F.lit(r"\u00")), low).otherwise(top)

    def unmarked(made: Column) -> Column:
        top = escaped(F.substring(made, F.lit(2), F.length(made) - 2))
        pieces = F.split(F.regexp_replace(top, rf'\G((?:{_STRING}|[^",:]++)*+)([,:])', "$1$2 "), f'"{_MARK}', -1)
        number = lambda p: F.substring_index(p, '"', 1)
        shown = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(let(number(p), _float), F.substring(p, F.length(number(p)) + 2, F.length(p)))))
        return F.array_join(shown, "")

    def written(raw: Column, marked: Column, made: Column) -> Column:
        return F.when(whole(marked, made), unmarked(made)).otherwise(raw)

    return let(F.coalesce(raw, F.lit("")), lambda r: let(marked(r), lambda m: let(parsed(m), lambda v: written(r, m, v))))

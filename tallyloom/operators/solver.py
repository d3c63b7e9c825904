"""Rule induction from worked examples, and verification of answers."""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import clean_answer, filled, let, parse_expression
from ..functions.transforms import TRANSFORMS, apply_rule

EXAMPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("left", "op", "right", "output")])
PAIR = "array<struct<input:string,output:string>>"


def examples_from_pairs(pairs: Column) -> Column:
    """Parsed examples of (input, output) structs: those with an expression, each once."""
    parsed = F.transform(pairs, lambda p: F.struct(parse_expression(p["input"]).alias("e"), p["input"].alias("i"), p["output"].alias("o")))
    good = F.filter(parsed, lambda p: p["e"].isNotNull() & p["i"].isNotNull() & (p["i"] != "") & p["o"].isNotNull() & (p["o"] != ""))
    flat = F.transform(good, lambda p: F.struct(p["e"]["left"].alias("left"), p["e"]["op"].alias("op"), p["e"]["right"].alias("right"), clean_answer(p["o"]).alias("output")))
    return F.coalesce(F.array_distinct(flat), F.array().cast(T.ArrayType(EXAMPLE)))


def examples_from_json(raw: Column) -> Column:
    """The fast path: JSON arrays of {input, output}."""
    return examples_from_pairs(F.from_json(raw, PAIR))


_EXPRESSION, _TEXT = re.compile(fixed.EXPRESSION), re.compile(fixed.EXAMPLE_TEXT)
_CLEAN = [re.compile(fixed.BOXED), re.compile(fixed.STATED, re.I), re.compile(fixed.QUOTED)]
_INPUT, _OUTPUT = ("input", "question", "prompt", "x"), ("output", "answer", "target", "y")


def _cleaned(text: str) -> str:
    text = text.strip()
    hit = next((m for p in _CLEAN if (m := p.search(text))), None)
    return re.sub("[^A-Za-z0-9]", "", hit.group(1) if hit else text)


def _pairs(value: object):
    """(input, output) texts anywhere in a parsed value, outermost first."""
    if isinstance(value, dict):
        a, b = (next((value[k] for k in names if value.get(k)), None) for names in (_INPUT, _OUTPUT))
        # a last candidate that is present but empty still counts as given
        a = value.get(_INPUT[-1]) if a is None else a
        b = value.get(_OUTPUT[-1]) if b is None else b
        if a is not None and b is not None:
            yield str(a), str(b)
        value = [v for v in value.values() if isinstance(v, (dict, list, tuple))]
    elif isinstance(value, str):
        yield from _TEXT.findall(value)
        return
    elif isinstance(value, (list, tuple)) and len(value) == 2 and not isinstance(value[0], (dict, list, tuple)):
        yield str(value[0]), str(value[1])
        return
    for v in value if isinstance(value, (list, tuple)) else ():
        yield from _pairs(v)


def parse_any(raw: str | None) -> list[dict]:
    """Examples out of JSON, else a Python literal, else plain text."""
    if not raw:
        return []
    value: object = raw
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(raw)
            break
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    out: dict[tuple, dict] = {}
    for a, b in _pairs(value):
        if m := _EXPRESSION.search(a):
            row = (m[1], m[2], m[3], _cleaned(b))
            out.setdefault(row, dict(zip(EXAMPLE.names, row, strict=True)))
    return list(out.values())


def examples_from_any(df: DataFrame, raw: str, name: str = "parsed") -> DataFrame:
    """The general path, in Arrow batches: ``df`` with the parsed examples of column ``raw``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(EXAMPLE))])
    kind = pa.list_(pa.struct([(c, pa.string()) for c in EXAMPLE.names]))
    place = df.columns.index(raw)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parse_any(x) for x in batch.column(place).to_pylist()], kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def _named(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


SOLVED = ("rule_type", "normalized_answer", "solver_answer", "verified", "confidence", "failure_type", "matched_examples", "total_examples", "solver_notes")


def _solution(question: Column, answer: Column, examples: Column) -> Column:
    names = list(TRANSFORMS)
    listed = F.array(*map(F.lit, names))
    text = lambda c: c.cast("string")

    def explained(s: Column) -> Column:
        """Of each example: does it have the question's operator, and which transforms explain it?"""
        hits = F.transform(s["all"], lambda e: _named(own=F.coalesce(e["op"] == s["q"]["op"], F.lit(False)), by=F.array(*(fn(e["left"], e["right"]) == e["output"] for fn in TRANSFORMS.values()))))
        return let(_named(q=s["q"], answer=s["answer"], hits=hits, own=F.filter(hits, lambda h: h["own"])), counted)

    def count(hits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.size(F.filter(hits, lambda h: F.get(h["by"], k))))

    def counted(s: Column) -> Column:
        return let(_named(q=s["q"], answer=s["answer"], n=F.size(s["hits"]), n_own=F.size(s["own"]), counts=count(s["hits"]), own_counts=count(s["own"])), induced)

    def first(counts: Column, n: Column) -> Column:
        return F.when(n > 0, F.get(listed, F.nullif(F.array_position(counts, n), F.lit(0)).cast("int") - 1))

    def induced(s: Column) -> Column:
        most = F.array_max(s["counts"])
        best = F.get(listed, F.array_position(s["counts"], most).cast("int") - 1)
        return let(_named(q=s["q"], answer=s["answer"], n=s["n"], n_own=s["n_own"], most=most, best=best, whole=first(s["counts"], s["n"]), part=first(s["own_counts"], s["n_own"])), ruled)

    def ruled(s: Column) -> Column:
        said = fixed.SOLVER_NOTES
        q, n, n_own, whole, part = s["q"], s["n"], s["n_own"], s["whole"], s["part"]
        rule = F.when(q.isNull(), "").otherwise(F.coalesce(whole, F.concat(F.lit("operator_conditioned_rule:"), q["op"], F.lit(":"), part), F.lit("")))
        matched = F.when(q.isNull() | (n == 0), 0).when(whole.isNotNull(), n).when(part.isNotNull(), n_own).otherwise(s["most"])
        notes = (
            F.when(q.isNull(), said["no_question"]).when(n == 0, said["no_examples"]).when(whole.isNotNull(), filled(said["all"], text(n)))
            .when(part.isNotNull(), filled(said["operator"], text(n_own), q["op"])).otherwise(filled(said["none"], s["best"], text(s["most"]), text(n)))
        )
        return let(_named(q=q, answer=s["answer"], n=n, rule=rule, matched=matched, notes=notes), applied)

    def applied(s: Column) -> Column:
        solved = F.when(s["rule"] != "", apply_rule(s["rule"], s["q"]["left"], s["q"]["right"])).otherwise("")
        return let(_named(q=s["q"], answer=s["answer"], n=s["n"], rule=s["rule"], matched=s["matched"], notes=s["notes"], solved=solved), judged)

    def judged(s: Column) -> Column:
        none, unruled = s["q"].isNull(), s["rule"] == ""
        verified = ~unruled & (s["answer"] != "") & (s["solved"] == s["answer"])
        said = fixed.SOLVER_FAILURES
        failure = F.when(none, said["no_question"]).when(unruled & (s["n"] == 0), said["no_examples"]).when(unruled, said["no_rule"])
        failure = failure.when(verified, said["verified"]).when(s["answer"] == "", said["no_answer"]).otherwise(said["mismatch"])
        confidence = F.when(none, "none").when(unruled, "low").when(verified & (s["matched"] == s["n"]), "high").when(s["solved"] != "", "medium").otherwise("low")
        return _named(rule_type=s["rule"], normalized_answer=s["answer"], solver_answer=s["solved"], verified=verified, confidence=confidence, failure_type=failure, matched_examples=s["matched"].cast("long"), total_examples=s["n"].cast("long"), solver_notes=s["notes"])

    return let(_named(q=parse_expression(question), answer=clean_answer(answer), all=F.coalesce(examples, F.array().cast(T.ArrayType(EXAMPLE)))), explained)


def solve(df: DataFrame, *, question: str = "question", answer: str = "answer", examples: str = "parsed") -> DataFrame:
    """``df`` with rule_type, normalized_answer, solver_answer, verified, confidence, failure_type, matched_examples,
    total_examples and solver_notes.

    The first transform that explains every example is the rule; else the first that explains every example with the
    question's operator.  Each row is solved once, as a list of one that is laid out: filters on what is found stay behind it.
    """
    return df.select(*(c for c in df.columns if c not in SOLVED), F.inline(F.array(_solution(F.col(question), F.col(answer), F.col(examples)))))


def reasoning_text(*, category: Column, question: Column, examples: Column, rule: Column, solver_answer: Column) -> Column:
    """The verified solution as text, a line for each example."""
    guess = category == "cryptarithm_guess"
    opening = F.when(guess, fixed.GUESS_OPENING).otherwise(fixed.DEDUCE_OPENING)
    shown = F.transform(examples, lambda e, i: filled(fixed.EXAMPLE_LINE, (i + 1).cast("string"), e["left"], e["op"], e["right"], e["output"]))
    closing = F.array(filled(fixed.RULE_LINE, rule), filled(fixed.APPLY_LINE, question), filled(fixed.SOLVED_LINE, solver_answer), filled(fixed.ANSWER_LINE, solver_answer))
    return F.array_join(F.concat(F.array(opening), shown, closing), "\n")

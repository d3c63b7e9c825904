import random
import re

from pyspark.sql import functions as F

from tallyloom.functions import fixed, matching
from tallyloom.operators import classify

PIECES = [
    "XOR", "xor", "xor_", "éxor", "and", "OR", "a&b", "a & b", "x | y", "miles", "mile", "smile", "0b101", "0b102", "0x1F", "ROT13", "rot", "if", "then", "\n", "truth table", "truth  table", "de morgan", "base 7", "base-7", "binary", "operation", "two's complement", "twos complement",
    "hex to decimal", "hexadecimal to decimal", "12 to hex", "bin to dec", "dec bin", "AB ? CD", "3 * 4", "3 - x", "×", "⊕", "<<", ">>", "shift left", "shift cipher", "find", "x", "solve", "for", "next element", "inferred rules", "roman numerals", "roman numeral", "XLIV", "convert a number", "base", "no leading zero",
]


def test_every_pattern_as_a_regular_expression_finds_it(spark):
    rnd = random.Random(1)
    texts = [rnd.choice(["", " ", "-"]).join(rnd.choices([*PIECES, " ", ". "], k=rnd.randint(0, 9))) for _ in range(1500)]
    patterns = list(dict.fromkeys([*classify.KEYWORDS, *(p for _, p in fixed.SINGLE_PATTERNS)]))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", matching.fold("t")).withColumn("w", matching.words_of(F.col("t"), patterns))
    for r in rows.select("i", *(matching.occurs(F.col("t"), F.col("w"), p).alias(f"p{k}") for k, p in enumerate(patterns))).collect():
        want = [bool(re.search(p, texts[r.i], re.I)) for p in patterns]
        assert list(r)[1:] == want, (texts[r.i], [p for p, a, b in zip(patterns, want, list(r)[1:], strict=True) if a != b])


def test_parts_of_patterns():
    assert matching.alternatives(r"a|b(c|d)|[|]|\|") == ["a", "b(c|d)", "[|]", r"\|"]
    assert matching.whole_words(r"\bmiles?\b") == ["mile", "miles"] and matching.whole_words(r"\bROT\d+\b") == []
    assert matching.held(r"hex(?:adecimal)? to decimal") == ["hex", " to decimal"] and matching.held(r"\btwo.?s complement\b") == ["two", "s complement"]
    assert matching.held(r"[A-Z]{2,}\s*\?\s*[A-Z]{2,}") == ["?"] and matching.held(r"colou?r*s+") == ["colo", "s"] and matching.held(r"(?<![a-z])\|(?![a-z])") == ["|"]


def test_expressions_behind_gates(spark):
    rows = classify.by_keywords(spark.createDataFrame([("XOR it",)], "t string"), category=F.lit(""), question=F.col("t"), examples=F.lit(""))
    assert rows._jdf.queryExecution().executedPlan().toString().count("RLIKE") <= 30  # of 105 alternatives

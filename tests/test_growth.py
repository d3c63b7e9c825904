"""Work that must not grow faster than the input: what a plan evaluates, and how often."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed, matching, text
from tallyloom.operators import classify, gates, logprob
from tallyloom.plans import derive, io_queries, queries
from tallyloom.sources import ingest, sinks

SF = "/root/testdata/sf0.001"


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]


@pytest.mark.parametrize("name", ["rule_conditioned", "rule_best_partial", "cot_text", "patch_build", "patch_rejected", "first_notes"])
def test_filters_do_not_solve_again(spark, name):
    found = filters(queries.QUERIES[name](spark, SF))
    assert found and not any("transform(" in f for f in found)


def test_expressions_in_long_texts(spark):
    """As the plain pattern finds them, without going back over a run of letters from each of its places."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(["ab", "7", "c", " ", "+", "-", "*", "é", "_", "\n", "====", "?"], k=rnd.randint(0, 25))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.operator_symbols(F.col("t")).alias("s"), text.parse_expression(F.col("t")).alias("e"))
    for r in rows.collect():
        want = [m.groups() for m in re.finditer(fixed.EXPRESSION, texts[r.i], re.A)]
        assert r.s == " ".join(sorted({w[1] for w in want})) and (r.e is None if not want else tuple(r.e) == want[0])
    began = time.time()
    long = spark.range(1).select(F.concat(F.repeat(F.lit("x"), 400_000), F.lit(" a+b")).alias("t")).select(text.operator_symbols(F.col("t")).alias("s"))
    assert long.first().s == "+" and time.time() - began < 20


def test_single_patterns_in_long_lines(spark):
    """As each pattern on its own finds them, without going over a line again from each place."""
    rnd = random.Random(4)
    pieces = [*"find value x solve equation bit shift binary number system each letter digit unique base 7 AB + cd AND or mod K".split(), "sum of", "send + more", "hand", "\n", "\n"]
    texts = ["", *(" ".join(rnd.choices(pieces, k=rnd.randint(0, 7))) for _ in range(600))]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    for name, p in fixed.SINGLE_PATTERNS:
        got = rows.select("t", text.found(F.col("t"), p).alias("a"), matching.occurs_in(F.col("t"), F.lower("t"), p).alias("b")).collect()
        assert all(r.a == r.b for r in got) and any(r.a for r in got if r.t), name
    began = time.time()
    long = spark.createDataFrame([("+" + "x" * 400_000,), ("find value " * 20_000 + "\n",)], "t string").select(classify.by_single_pattern(F.col("t")).alias("c"))
    assert [r.c for r in long.collect()] == ["other", "other"] and time.time() - began < 20


def test_answers_are_extracted_once(spark):
    """Neither by filters below the step that deals rows over the cores, nor for a filter on the other side of the join."""
    found = filters(queries.QUERIES["replay_manifest"](spark, SF))
    assert found and not any("RLIKE" in f for f in found)


def test_marker_of_an_answer_is_searched_once(spark):
    made = spark.range(1).select(logprob.answer_start(F.array(F.lit("the answer "), F.lit("is b"))).alias("a"))
    assert made._jdf.queryExecution().analyzed().toString().count("(?id)") == 2 and made.first().a == 1


def test_reports_join_once(spark, monkeypatch):
    joined, calls = queries._joined, []
    monkeypatch.setattr(io_queries, "_joined", lambda *a: calls.append("joined") or joined(*a))
    monkeypatch.setattr(io_queries.derive, "scored", lambda *a, own=derive.scored: calls.append("scored") or own(*a))
    summary, groups, kinds, scored = io_queries._report_inputs(spark, SF)
    assert sorted(calls) == ["joined", "scored"]
    assert all("Join" not in f._jdf.queryExecution().optimizedPlan().toString() for f in (summary, groups, kinds, scored))


def test_a_group_of_lines_goes_to_several_tasks(spark, tmp_path):
    """Lines are numbered through a group's files, in the order of their keys, blank ones included."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        k = F.col("id")
        rows = spark.range(5000).select("id", (k % 2).alias("part"), F.concat(F.when(k % 10 == 0, "\n").otherwise(""), F.lit('{"id": '), k.cast("string"), F.lit("}")).alias("value"))
        sinks.write_text_groups(rows.repartition(3), str(tmp_path / "out"), "part", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = ingest.read_jsonl(spark, str(tmp_path / "out"), "id long", line_numbers=True, folders=True)
    assert read.select("_source_path").distinct().count() > 2
    got = {r.id: r._line for r in read.select("id", "_line").collect()}
    want = {}
    for part in (0, 1):
        n = 0
        for i in range(part, 5000, 2):
            n += 2 if i % 10 == 0 else 1
            want[i] = n
    assert got == want


def test_grams_of_a_holdout_are_made_once(spark, monkeypatch):
    own, kept = gates.written, []
    monkeypatch.setattr(gates, "written", lambda df: kept.append(df.columns) or own(df))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z"), (3, "a b c q r s")], "id long, text string")
    got = gates.overlaps(docs, spark.createDataFrame([("a b c d",)], "text string"), "id", n=3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 4, 2), (3, 4, 1)] and kept == [["_grams"], ["id", "n_grams", "_grams"]]

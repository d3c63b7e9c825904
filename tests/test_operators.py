import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.functions.transforms import TRANSFORMS
from tallyloom.operators import aggregate, failures, joins, logprob, patch, solver
from tallyloom.plans import derive, report, steps
from tallyloom.sources import ingest, sinks
from tallyloom.streaming import resume

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def solve(spark, rows):
    df = solver.examples_from_any(frame(spark, rows, "question string, answer string, examples string"), "examples")
    return solver.solve(df).collect()


@pytest.mark.parametrize(("variant", "answer"), list(zip(["ABCD", "CDAB", "BACD", "ABDC", "BADC", "ACBD", "CADB"], ["EFGH", "GHEF", "FEGH", "EFHG", "FEHG", "EGFH", "GEHF"], strict=True)))
def test_seven_rules(spark, variant, answer):
    [r] = solve(spark, [("EF?GH", answer, json.dumps([{"input": "AB?CD", "output": variant}]))])
    assert r.verified and r.solver_answer == answer and r.confidence == "high"
    assert r.rule_type == list(TRANSFORMS)[["ABCD", "CDAB", "BACD", "ABDC", "BADC", "ACBD", "CADB"].index(variant)]


def test_solver_cases(spark):
    both = json.dumps([{"input": "AB@CD", "output": "ABCD"}, {"input": "IJ#KL", "output": "KLIJ"}])
    rows = [("EF#GH", "GHEF", both), ("EF?GH", "EFGH", ""), ("no operator here", "x", both), ("EF?GH", "", json.dumps([{"input": "AB?CD", "output": "ABCD"}])), ("EF?GH", "ZZ", "AB?CD -> ABCD"), ("EF?GH", "EFGH", "['AB?CD', 'ABCD']")]
    got = solve(spark, rows)
    assert (got[0].rule_type, got[0].solver_answer, got[0].confidence) == ("operator_conditioned_rule:#:reverse_concat", "GHEF", "medium")
    assert [r.failure_type for r in got[1:]] == ["guess failure", "extraction failure", "answer format failure", "answer mismatch", ""]


def test_cleaning_and_examples(spark):
    rows = frame(spark, [("\\boxed{ABCD}",), ("answer: ABCD.",), ("it is 'ABCD'",), (None,)], "t string")
    assert [r.c for r in rows.select(text.clean_answer(F.col("t")).alias("c")).collect()] == ["ABCD", "ABCD", "ABCD", ""]
    nested = {"train": [{"x": "AB?CD", "y": "CDAB"}, {"x": "AB?CD", "y": "CDAB"}], "more": ["EF+GH", "EFGH"]}
    assert [e["output"] for e in solver.parse_any(json.dumps(nested))] == ["CDAB", "EFGH"]
    assert solver.parse_any(None) == solver.parse_any("") == []


def test_extraction_quirks(spark):
    texts = ["Therefore, the answer is 42.", "\\boxed{ }", "", "x\ny\nlast line 7", "a \\boxed{1\n2} b", None]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("x", text.extract_answer(F.col("t")))
    got = [r.x.pred_answer for r in rows.orderBy("i").collect()]
    assert got == ["theansweris42", "", None, "last line 7", "1\n2", None]
    cut = rows.select(text.extract_answer(F.col("t"), F.lit(True))["pred_answer"].alias("p")).collect()
    assert cut[3].p is None


def test_template_hand_check(spark):
    rows = [("a", "bit_manipulation", "xor", False, -3.0), ("b", "ALL", "ALL", False, None), *((c, c, "x", True, None) for c in ("cipher", "cryptarithm", "equation", "numeral_conversion"))]
    df = frame(spark, rows, "problem_id string, category string, subcategory string, is_correct boolean, min_logprob double").withColumn("answer_min_logprob", F.col("min_logprob"))
    got = aggregate.with_priority(aggregate.failure_groups(df)).orderBy("rank").collect()
    assert [(r.category, r.priority_score) for r in got] == [("bit_manipulation", 4), ("ALL", 2), ("cipher", 1), ("cryptarithm", 1), ("equation", 1), ("numeral_conversion", 1)]


def test_failure_details(spark):
    df = frame(spark, [("XIV", "XVI"), ("12", "21"), ("12", "13"), ("", "1")], "p string, g string")
    assert [r.x for r in df.select(failures.digits_swapped(F.col("p"), F.col("g")).alias("x")).collect()] == [True, True, False, False]


def test_logprob_edges(spark):
    df = frame(spark, [(1, [-1.0, -5.0, -5.0], ["a ", "the answer ", "is b"]), (2, [], []), (3, [-0.5] * 12, ["x"] * 12)], "problem_id int, token_logprobs array<double>, tokens array<string>")
    got = logprob.stats(df).withColumn("loop", logprob.degenerate(F.col("token_logprobs"))).orderBy("problem_id").collect()
    assert (got[0].min_logprob, got[0].lowest_logprob_token, got[0].answer_start, got[0].answer_low_conf_token_count) == (-5.0, "the answer ", 2, 1)
    assert got[1].min_logprob is None and got[1].logprob_source == "missing" and got[1].low_conf_token_count == 0
    assert [r.loop for r in got] == [False, False, True]


def test_chain_and_patch(spark, tmp_path):
    rows = [{"problem_id": "forward", "category": "cryptarithm_deduce", "question": "EF?GH", "answer": "EFGH", "examples": [{"input": "AB?CD", "output": "ABCD"}]}, {"problem_id": "other", "category": "arithmetic", "question": "1+1", "answer": "2"}]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n[1, 2]\n")
    schema = "problem_id string, category string, question string, answer string, examples array<struct<input:string,output:string>>"
    found = ingest.read_jsonl(spark, f"file://{path}", schema)
    assert found.count() == 2
    inventory = ingest.inventory(found, found.limit(0))
    assert [r.problem_id for r in inventory.collect()] == ["forward"] and not inventory.first().current_corpus_included
    solved = solver.solve(solver.examples_from_any(inventory, "examples"))
    said = solver.reasoning_text(category=F.col("category"), question=F.col("question"), examples=F.col("parsed"), rule=F.col("rule_type"), solver_answer=F.col("solver_answer"))
    good, bad = patch.build(solved.withColumn("reasoning_text", said), order="problem_id", max_rows=5, strict=True)
    assert patch.validate(good, require_rows=True) == 1 and bad.count() == 0
    [line] = [json.loads(r.value) for r in sinks.jsonl(good).collect()]
    assert [m["role"] for m in line["messages"]] == ["user", "assistant"] and line["metadata"]["verified"] is True
    assert list(line) == sorted(line)
    with pytest.raises(ValueError, match="no rows"):
        patch.validate(good.limit(0), require_rows=True)
    broken = good.withColumn("answer", F.lit(""))
    with pytest.raises(ValueError, match="missing answer"):
        patch.validate(broken)
    assert "Coverage" in report.coverage(solved)


def test_sources(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"problem_id": "a"}\n{oops\n')
    with pytest.raises(Exception, match="malformed JSON line"):
        ingest.read_jsonl(spark, f"file://{path}", "problem_id string").collect()
    assert [r.problem_id for r in ingest.completed_ids(spark, f"file://{path}").collect()] == ["a"]
    assert ingest.read_or_empty(spark, f"file://{tmp_path}/none.jsonl", "problem_id string").count() == 0
    csv = tmp_path / "p.csv"
    csv.write_text('ID,Problem,Answer,problem_id\n7,"a ""q"", b",x,8\n9,,y,\n')
    rows = ingest.with_aliases(ingest.read_csv(spark, f"file://{csv}")).collect()
    assert [(r.problem_id, r.question, r.answer) for r in rows] == [("7", 'a "q", b', "x"), ("9", "", "y")]
    rows = ingest.numbered(frame(spark, [("q",), ("r",)], "prompt string"))
    assert sorted(r.problem_id for r in ingest.with_aliases(rows, "_ord").collect()) == ["row_0", "row_1"]


def test_joins(spark):
    rows = frame(spark, [("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, o int")
    assert {(r.k, r.v) for r in joins.keep_last(rows, "k", "o").collect()} == {("a", 2), ("b", 3)}
    done = rows.where("k = 'a'")
    left = joins.unfinished(rows, done, "k")
    assert joins.resumed(done, left).count() == 3 and joins.unfinished(left, left, "k").count() == 0


def test_steps_and_report(spark):
    runner = steps.analysis()
    got = runner.run({"predictions": derive.scored(spark, SF), "tokens": derive.tokens(spark, SF)})
    assert all(x["status"] == "ok" for x in runner.log), runner.log
    assert "Weakest categories" in report.recommendation(got["summary"], got["priority"], got["failure_types"])
    assert runner.metrics(spark).count() == len(runner.log)
    blocked = steps.analysis()
    blocked.run({"tokens": got["logprob"]}, only=["priority"])
    assert {x["status"] for x in blocked.log} == {"skipped", "blocked"}


def test_streaming_once_and_restart(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = derive.predictions(spark, SF).select("problem_id", "raw_output", "gold_answer").limit(20)
    rows.union(rows).write.json(source)
    for _ in range(2):
        stream = resume.arriving(spark, source, rows.schema)
        resume.append(resume.scored(stream), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 20

"""Operators over sources, sinks and the specifications, on small inputs."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed, text
from tallyloom.operators import aggregate, gates, patch, sampling
from tallyloom.plans import report, steps
from tallyloom.sources import ingest, sinks
from tallyloom.streaming import resume


def test_line_numbers(spark, tmp_path):
    for name, body in (("a", '{"problem_id": "a"}\n\n{"problem_id": "b"}\n'), ("b", '\n{"problem_id": "c"}\n\n{oops\n')):
        (tmp_path / f"{name}.jsonl").write_text(body)
    with pytest.raises(Exception, match=r"b\.jsonl:4: malformed JSON line"):
        ingest.read_jsonl(spark, f"file://{tmp_path}", "problem_id string", line_numbers=True).collect()
    rows = ingest.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "problem_id string", line_numbers=True, ordered=True)
    assert [(r.problem_id, r._ord) for r in rows.orderBy("_ord").collect()] == [("a", 0), ("b", 1)]


def test_numbers_follow_partitions(spark):
    rows = spark.range(1000, numPartitions=7)
    assert [(r.id, r._ord) for r in ingest.numbered(rows).orderBy("id").collect()] == [(i, i) for i in range(1000)]
    assert ingest.numbered(rows.where("id < 0")).count() == 0


def test_paths(spark, tmp_path):
    for n in ("p_v1.csv", "p_v2.csv"):
        (tmp_path / n).write_text("a\n1\n")
    assert ingest.first_existing(spark, [f"file://{tmp_path}/x.csv", f"file://{tmp_path}/p_v1.csv"]).endswith("p_v1.csv")
    assert ingest.first_existing(spark, [f"file://{tmp_path}/x.csv"], f"file://{tmp_path}/p_v*.csv").endswith("p_v2.csv")
    assert ingest.first_existing(spark, [f"file://{tmp_path}/x.csv"]) is None
    assert ingest.load(spark, [f"file://{tmp_path}/x.csv"], "problem_id string").count() == 0


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": {"d": "\\u00e9", "c": [2, {"y": 0, "x": 1}]}}',), ("plain",), (None,), ("",)], "t string")
    assert [r.c for r in rows.select(text.canonical_json(F.col("t")).alias("c")).collect()] == ['{"a": {"c": [2, {"x": 1, "y": 0}], "d": "é"}, "b": 1}', "plain", "", ""]


def test_failure_modes(spark):
    rows = [
        (1, "bit_manipulation", True, None, None, -9.0, None), (2, "bit_manipulation", False, "empty_output", "xor_error", -9.0, None), (3, "cipher", False, None, None, None, "regression"),
        (4, "arithmetic", False, None, None, -1.0, None), (5, "arithmetic", False, "no_extractable_answer", None, -2.5, None), (6, "cryptarithm", False, None, "carry_error", None, None),
    ]
    df = spark.createDataFrame(rows, "problem_id int, category string, is_correct boolean, parse_error_type string, failure_type string, min_logprob double, delta_label string")
    got = {r.problem_id: (r.failure_mode_primary, r.failure_mode_secondary) for r in gates.with_failure_modes(df).collect()}
    assert got == {
        1: (None, None), 2: ("FORMAT_FAILURE", "OPERATOR_CONFUSION"), 3: ("PREPOST_CONVERSION_REGRESSION", "EASY_TASK_REGRESSION"), 4: ("UNKNOWN", None),
        5: ("EXTRACTION_FAILURE", "LOW_LOGPROB_COLLAPSE"), 6: ("POSITIONAL_MISMATCH", None),
    }
    bare = gates.with_failure_modes(df.drop("failure_type", "min_logprob", "delta_label")).collect()
    assert {r.failure_mode_primary for r in bare} == {None, "FORMAT_FAILURE", "EASY_TASK_REGRESSION", "UNKNOWN", "EXTRACTION_FAILURE"}
    assert len(fixed.FAILURE_LABELS) == 10


def test_stratified_in_one_pass(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None, i * 2) for i in range(300)], "k int, category string, other int")
    got = sampling.stratified(rows, {"a": 20, "b": 5, "z": 10}, key="k").collect()
    assert len(got) == 35 and len({r.k for r in got}) == 35 and all(r.other == 2 * r.k for r in got)
    drawn = [r for r in got if r.drawn == "quota"]
    assert sorted(r.category for r in drawn) == ["a"] * 20 + ["b"] * 5
    rest = sorted(set(range(300)) - {r.k for r in drawn})[:10]
    assert sorted(r.k for r in got if r.drawn == "backfill") == rest
    assert len(sampling.stratified(rows.limit(4), {"a": 20, "b": 5}, key="k").collect()) == 4


def test_confidence_falls_back(spark):
    rows = spark.createDataFrame([("x", "s", False, None, -5.0), ("x", "s", False, None, None)], "category string, subcategory string, is_correct boolean, min_logprob double, answer_min_logprob double")
    [g] = aggregate.failure_groups(rows).collect()
    assert (g.n_wrong_low_conf, g.n_wrong_high_conf, g._min) == (1, 1, -5.0)


def test_line_numbers_in_blocks(spark, tmp_path):
    """Files that are read in many blocks, dealt to tasks in whatever order."""
    sizes = {"a": 4000, "b": 900, "c": 1}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"k": "{name}{i}", "pad": "{"x" * (i % 90)}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(n)))
    want = {f"{name}{i}": i + 1 + (i + 6) // 7 for name, n in sizes.items() for i in range(n)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = ingest.read_jsonl(spark, f"file://{tmp_path}", "k string", line_numbers=True)
        assert {r.k: r._line for r in rows.collect()} == want
        assert ingest.read_lines(spark, f"file://{tmp_path}").select("_source_path", "_line").distinct().count() == sum(sizes.values()) + sum((n + 6) // 7 for n in sizes.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_groups_are_replaced_and_exported_once(spark, tmp_path):
    path = f"file://{tmp_path}/groups"
    for rows in ([("a", "x", 1), ("b", "y", 2)], [("a", "z", 3)], [("c", "w", 4)], [("a", "z", 3)]):
        sinks.write_groups(spark.createDataFrame(rows, "category string, failure_type string, count long"), path, "category")
    sinks.export_csv(spark.read.parquet(path), f"{path}.csv", ["category", "failure_type", "count"], ["category"])
    [csv] = [f for f in (tmp_path / "groups.csv").iterdir() if f.name.startswith("part-")]
    assert csv.read_text().splitlines() == ["category,failure_type,count", "a,z,3", "b,y,2", "c,w,4"]


def test_stream_keeps_each_key_once_without_state(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, f"\\boxed{{{i}}}", f"{i}") for i in range(30)], "problem_id long, raw_output string, gold_answer string")

    def run():
        resume.append_once(resume.scored(resume.arriving(spark, source, rows.schema, files_each=1), once=False), out, state).awaitTermination()
        return sorted(r.problem_id for r in spark.read.parquet(out).collect())

    rows.where("problem_id < 20").repartition(3).write.json(source)
    assert run() == list(range(20)) == run()
    marks = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for mark in (marks[-1], marks[-1].parent / f".{marks[-1].name}.crc"):
        mark.unlink(missing_ok=True)
    rows.where("problem_id >= 10").repartition(2).write.mode("append").json(source)
    assert run() == list(range(30))
    assert not (tmp_path / "state" / "state").exists()


def test_steps_are_kept_until_their_input_changes(spark, tmp_path):
    calls = []

    def go(rows, version="1"):
        rows.write.mode("overwrite").parquet(f"file://{tmp_path}/in")
        runner = steps.Runner([
            steps.Step("double", lambda r: (calls.append("double"), r["rows"].selectExpr("id * 2 as id"))[1], ("rows",), version=version), steps.Step("few", lambda r: (calls.append("few"), r["double"].where("id < 4"))[1], ("double",)),
            steps.Step("gate", lambda r: r["few"], ("few",), when=lambda n: n["few"] > 2),
        ], folder=f"file://{tmp_path}/kept")
        out = runner.run({"rows": spark.read.parquet(f"file://{tmp_path}/in")})
        calls.append([(x["step"], x["status"], x["rows"]) for x in runner.log])
        return sorted(r.id for r in out["few"].collect())

    assert go(spark.range(5)) == [0, 2] and calls == ["double", "few", [("double", "ok", 5), ("few", "ok", 2), ("gate", "gated", None)]]
    runner = steps.Runner([steps.Step("double", None, ("rows",)), steps.Step("few", None, ("double",))], folder=f"file://{tmp_path}/kept")
    runner.run({"rows": spark.read.parquet(f"file://{tmp_path}/in")})
    assert [x["status"] for x in runner.log] == ["kept", "kept"]  # nothing is called
    assert go(spark.range(1, 9)) == [2] and calls[-1][0] == ("double", "ok", 8)
    assert go(spark.range(1, 9), version="2") == [2] and calls[-1][0][1] == "ok"


def test_report_is_collected_in_one_job(spark):
    summary = spark.createDataFrame([("overall", "ALL", "ALL", 3, 0.5, 1.0, 7.0), ("category", "a", "ALL", 3, 0.5, 1.0, 7.0)], "split string, category string, subcategory string, n long, accuracy double, parse_success_rate double, avg_generation_token_count double")
    groups = spark.createDataFrame([(None, "a", "x", 3, 0.5, None, 1, 0, 3, "why"), ("other", "b", "y", 1, 0.1, -1.0, 1, 0, 5, "not of a category")], "split string, category string, subcategory string, n long, accuracy double, avg_min_logprob double, n_wrong_low_conf long, n_correct_low_conf long, priority_score int, priority_reason string")
    kinds = spark.createDataFrame([("a", "carry_error", 2, 66.7), ("a", "unknown", 1, 33.3)], "category string, failure_type string, count long, pct double")
    scored = spark.createDataFrame([(1, "a", True, -2.5), (2, "a", False, -4.0), (3, "a", True, -0.1)], "problem_id long, category string, is_correct boolean, answer_min_logprob double")
    said = report.recommendation(summary, groups, kinds, scored)
    assert "| Accuracy | 0.5000 |" in said and "- `a/x`: accuracy 0.5000 (n = 3)" in said and "- `b/y`: priority 5, not of a category" in said
    weakest = said.split("### Weakest categories")[1].split("###")[0]
    assert "b/y" not in weakest and "| a | x | 3 | 0.5000 | N/A | 1 | 0 | 3 |" in said
    assert "## a: commonest failures\n\n| failure_type | count | pct |\n| --- | --- | --- |\n| carry_error | 2 | 66.7000% |\n| unknown | 1 | 33.3000% |" in said
    assert "| 1 | a | -2.5000 |" in said.split("## Protected cases")[1].split("## Replay")[0] and "| 2 | a | -4.0000 |" in said.split("## Replay cases")[1]
    empty = report.recommendation(*(df.limit(0) for df in (summary, groups, kinds, scored)))
    assert "| Problems | N/A |" in empty and "No rows." in empty


def test_text_after_a_value_is_malformed(spark, tmp_path):
    rows = ['{"a": 1} x', "1,2", '{"a": 1}], [', '{"a":1},2],[', "", " 1 ", '{"a": 1}', "null", None, '"x"']
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, v string").select("i", text.json_value(F.col("v")).isNotNull().alias("ok"))
    assert [r.ok for r in frame.orderBy("i").collect()] == [False] * 5 + [True, True, True, False, True]
    (tmp_path / "x.jsonl").write_text('{"problem_id": "a"}\n\n{"problem_id": "b"} c\n')
    with pytest.raises(Exception, match=r"x\.jsonl:3: malformed JSON line"):
        ingest.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "problem_id string", line_numbers=True).collect()
    assert [r.problem_id for r in ingest.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "problem_id string", strict=False).collect()] == ["a"]
    (tmp_path / "p.jsonl").write_text("[1]\n\n{}\n")
    got = [(r.line, r.errors[0]) for r in patch.check_file(spark, f"file://{tmp_path}/p.jsonl").orderBy("line").collect()]
    assert got == [(1, "not an object"), (3, "unexpected category None")]

"""Queries over sources and sinks: tables go out through a sink and come back through a scan."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, failures, joins, logprob, patch
from ..sources import ingest, sinks
from ..sources.scratch import folder, written
from ..streaming import resume
from . import derive, duck, report, steps
from .derive import table
from .queries import ORACLE_SQL, _joined, query


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN props END AS props FROM events")
def jsonl_round_trip(spark, sf_dir):
    """Strict scan of lines with blank ones and lists between them."""
    path, rows = folder(spark), table(spark, sf_dir, "events")
    lines = sinks.jsonl(rows.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props")))
    lines.unionAll(rows.limit(50).select(F.lit("  "))).unionAll(rows.limit(50).select(F.lit("[1, 2]"))).write.text(path)
    return ingest.read_jsonl(spark, path, "event_id long, user_id long, event_type string, props string").drop("_source_path")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_brand || '\"' AS p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS p_type FROM part")
def csv_round_trip(spark, sf_dir):
    """Quotes, commas and empty cells survive; everything comes back as text."""
    path = folder(spark)
    kind = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_name"), kind.alias("p_type"))
    sinks.write_csv(rows, path, ["p_partkey", "p_name", "p_type"], strict=True)
    return ingest.read_csv(spark, path)


@query("SELECT p_partkey::VARCHAR AS problem_id, p_name AS question, p_type AS answer FROM part")
def csv_aliases(spark, sf_dir):
    """Headers in other cases and words; ``id`` beats ``problem_id``."""
    path = folder(spark)
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("problem_id"), F.col("p_partkey").alias("ID"), F.col("p_name").alias("Problem"), F.col("p_type").alias("ANSWER"))
    sinks.write_csv(rows, path, rows.columns)
    return ingest.with_aliases(ingest.read_csv(spark, path)).select("problem_id", "question", "answer")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'j' ELSE 'c' END || o_orderkey AS problem_id, o_orderpriority AS question, o_orderstatus AS answer FROM orders")
def mixed_inputs(spark, sf_dir):
    """Several files of both formats by suffix, one of them missing."""
    path, rows = folder(spark), table(spark, sf_dir, "orders")
    named = lambda letter: (F.concat(F.lit(letter), F.col("o_orderkey").cast("string")).alias("problem_id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"))
    sinks.write_jsonl(rows.where("o_orderkey % 2 = 0").select(*named("j")), f"{path}/a.jsonl")
    sinks.write_csv(rows.where("o_orderkey % 2 = 1").select(*named("c")), f"{path}/b.csv", ["problem_id", "question", "answer"])
    found = ingest.first_existing(spark, [f"{path}/none.csv"], f"{path}/*.csv")
    return ingest.load(spark, [f"{path}/none.jsonl", f"{path}/a.jsonl", found], "problem_id string, question string, answer string").select("problem_id", "question", "answer")


@query("SELECT 'csv' AS source, 0 AS n UNION ALL SELECT 'jsonl', 0 UNION ALL SELECT 'there', count(*) FROM orders UNION ALL SELECT 'loaded', count(*) FROM orders")
def missing_inputs(spark, sf_dir):
    """Files that are missing have no rows, alone and beside one that is there."""
    path, schema = folder(spark), "problem_id string, question string"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("problem_id"), F.col("o_orderpriority").alias("question"))
    sinks.write_jsonl(rows, f"{path}/there.jsonl")
    frames = {
        "csv": ingest.read_csv(spark, f"{path}/none.csv"), "jsonl": ingest.read_or_empty(spark, f"{path}/none.jsonl", schema), "there": ingest.read_or_empty(spark, f"{path}/there.jsonl", schema),
        "loaded": ingest.load(spark, [f"{path}/none.csv", f"{path}/there.jsonl", f"{path}/none.jsonl"], schema),
    }
    return ingest.union([df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n") for name, df in frames.items()])


@query("""SELECT event_id, event_id % 4 AS part, row_number() OVER w + sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER w AS line
  FROM events WINDOW w AS (PARTITION BY event_id % 4 ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def line_numbers(spark, sf_dir):
    """Numbers of lines in four folders of files, with blank lines between them."""
    path, rows = folder(spark), table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("part"))
    line = F.concat(F.when(F.col("event_id") % 10 == 0, "\n").otherwise(""), F.to_json(F.struct("event_id")))
    sinks.write_text_groups(rows.withColumn("value", line), path, "part", "event_id")
    read = ingest.read_jsonl(spark, path, "event_id long", line_numbers=True, folders=True)
    return read.select("event_id", (F.col("event_id") % 4).alias("part"), F.col("_line").alias("line"))


@query(f"WITH {duck.ALL_CASES} SELECT category, failure_type, count(*) AS count FROM all_cases GROUP BY ALL")
def groups_rewritten(spark, sf_dir):
    """Counts of each category are appended to one table, first wrong ones and then again; what was there for a category is replaced."""
    path = f"{folder(spark)}/counts"
    counted = written(failures.all_cases(_joined(spark, sf_dir), order="problem_id").groupBy("category", "failure_type").count())
    for times in (2, 1):
        for category in failures.PROCESSES:
            sinks.write_groups(counted.where(F.col("category") == category).withColumn("count", F.col("count") * times), path, "category")
    sinks.export_csv(spark.read.parquet(path), f"{path}.csv", ["category", "failure_type", "count"], ["category", "failure_type"])
    return ingest.read_csv(spark, f"{path}.csv").withColumn("count", F.col("count").cast("long"))


@query(f"WITH {duck.SCORED} SELECT problem_id, pred_answer, is_correct FROM scored")
def stream_restarted(spark, sf_dir):
    """Files arrive in two runs, some rows twice; between the runs the mark of the last batch is lost, as after a failure behind the sink."""
    path = folder(spark)
    source, out, state = (f"{path}/{n}" for n in ("in", "out", "state"))
    rows = derive.predictions(spark, sf_dir).select("problem_id", "raw_output", "gold_answer")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for part in (0, 1):
        arrived = rows.where((F.col("problem_id") % 2 == part) | (F.col("problem_id") % 5 == 0))
        arrived.repartition(3, "problem_id").write.mode("append").json(source)
        stream = resume.scored(resume.arriving(spark, source, rows.schema, files_each=2), once=False)
        resume.append_once(stream, out, state).awaitTermination()
        marks = fs.Path(f"{state}/commits")
        disk = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if part == 0:
            last = max((int(f.getPath().getName()) for f in disk.listStatus(marks) if f.getPath().getName().isdigit()))
            disk.delete(fs.Path(f"{state}/commits/{last}"), False)
    return spark.read.parquet(out).select("problem_id", "pred_answer", "is_correct")


@query("SELECT o_orderkey::VARCHAR AS problem_id FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0")
def resume_scan(spark, sf_dir):
    """What is left after an interrupted run: ids without a whole line, broken lines don't count."""
    path = folder(spark)
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("problem_id"), "o_orderkey")
    line = F.to_json(F.struct("problem_id"))
    ids.where("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(line, 1, 14)).otherwise(line)).write.text(path)
    return joins.unfinished(ids.select("problem_id"), ingest.completed_ids(spark, path), "problem_id")


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || ' ...[truncated]' ELSE text END AS raw_output FROM documents")
def predictions_appended(spark, sf_dir):
    """Two runs append to one file of predictions; long outputs are cut, and the configuration stays behind."""
    path, rows = folder(spark), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_output"), F.struct("lang").alias("generation_config"))
    for part in (0, 1):
        sinks.write_predictions(rows.where(F.col("doc_id") % 2 == part), path)
    return ingest.read_jsonl(spark, path, "doc_id long, raw_output string, generation_config string").select("doc_id", "raw_output")


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def markdown_table(spark, sf_dir):
    return spark.createDataFrame([(sinks.markdown_of(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "report string")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN event_type END, 'None') AS name FROM events")
def first_column(spark, sf_dir):
    """The first column that is there, even where its value is null."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("name"), F.col("user_id").cast("string").alias("other"))
    return rows.select("event_id", ingest.first_column(rows, ["missing", "name", "other"]).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'cryptarithm_deduce' WHEN doc_id % 4 = 1 THEN 'cryptarithm_guess' ELSE '' END AS category FROM documents WHERE NOT contains(lower(text), 'cryptarithm_')")
def category_anywhere(spark, sf_dir):
    """A label somewhere in the record, in whatever case; where both occur, deduce counts."""
    k = F.col("doc_id") % 4
    note = F.when(k == 0, "see Cryptarithm_Deduce").when(k == 1, "a CRYPTARITHM_GUESS one").when(k == 2, "cryptarithm_guess or cryptarithm_deduce").otherwise("none")
    rows = table(spark, sf_dir, "documents").where("not contains(lower(text), 'cryptarithm_')").select("doc_id", "text", note.alias("note"))
    return rows.select("doc_id", ingest.detect_category(rows).alias("category"))


_GOOD = """{"category": "cryptarithm_guess", "answer": "A", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "metadata": {"verified": true}}"""
#: Lines of a patch file, and what is wrong with them.
_LINES = {
    _GOOD: "", f"{_GOOD} x": "invalid JSON", "[1, 2]": "not an object", "{oops": "invalid JSON", _GOOD.replace("true", '"true"'): "metadata.verified must be true", _GOOD.replace("user", "bot"): "message 1 role must be 'user'",
    _GOOD.replace('"A"', "0").replace("cryptarithm_guess", "chat"): "unexpected category 'chat'; missing answer", '{"messages": [1, {"role": "assistant"}], "metadata": 5, "answer": "x", "category": null}':
    "unexpected category None; message 1 must be an object; message 2 missing content; metadata must be an object", '{"category": "cryptarithm_deduce", "answer": [1], "messages": [], "metadata": {"verified": true}}': "expected two chat messages", "7": "not an object",
}


@query(f"""SELECT o_orderkey % 3 AS part, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) AS line, [{', '.join(duck.q(e) for e in _LINES.values())}][o_orderkey % {len(_LINES)} + 1] AS errors FROM orders""")
def patch_file_checked(spark, sf_dir):
    """Lines of every kind in three folders of files, each judged under its number in its folder."""
    path, k = folder(spark), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, (k % 3).alias("part"), derive.pick(k % len(_LINES), list(_LINES)).alias("value"))
    sinks.write_text_groups(rows, path, "part", "o_orderkey")
    checked = patch.check_file(spark, path, folders=True)
    return checked.select(F.regexp_extract("_source_path", r"part=(\d+)", 1).cast("long").alias("part"), "line", F.array_join("errors", "; ").alias("errors"))


_STEPS = {"summary": "summary_rollup", "priority": "failure_priority", "cases_cryptarithm": "failure_cases_cryptarithm", "cases_bit_manipulation": "failure_cases_bit", "cases_numeral_conversion": "failure_cases_numeral", "failure_types": "failure_type_counts"}


def _log_sql() -> str:
    counted = [f"SELECT '{step}' AS step, (SELECT count(*) FROM ({ORACLE_SQL[name]})) AS n" for step, name in _STEPS.items()]
    counted.append("SELECT 'logprob', (SELECT count(DISTINCT l_orderkey) FROM lineitem)")
    told = "SELECT * FROM (VALUES ('broken', 'failed', 'no such thing'), ('after', 'blocked', 'needs broken'), ('left out', 'skipped', ''), ('only without priorities', 'gated', '')) t(step, status, message)"
    runs = "SELECT * FROM (VALUES (1, 'ok'), (2, 'kept')) r(run, status)"
    return f"""WITH counted AS ({' UNION ALL '.join(counted)}), told AS ({told}), runs AS ({runs})
  SELECT run, step, status, n AS rows, '' AS message FROM counted, runs UNION ALL SELECT run, step, told.status, NULL, message FROM told, runs"""


@query(_log_sql())
def step_log(spark, sf_dir):
    """All steps of the analysis twice: the second run keeps what the first wrote.  A failed step blocks those that need it, a gate asks for rows."""

    def fail(_):
        raise ValueError("no such thing")

    given = {"predictions": derive.scored(spark, sf_dir), "tokens": derive.tokens(spark, sf_dir)}
    at, out = folder(spark), []
    for run in (1, 2):
        runner = steps.analysis(folder=at)
        runner.steps += [steps.Step("broken", fail), steps.Step("after", lambda r: r["broken"], ("broken",)), steps.Step("left out", fail), steps.Step("only without priorities", fail, when=lambda rows: rows["priority"] == 0)]
        runner.run(given, skip=["left out"])
        out.append(runner.metrics(spark).select(F.lit(run).alias("run"), "step", "status", "rows", "message"))
    return ingest.union(out)


def _report_sql() -> str:
    number = lambda c: f"coalesce(printf('%.4f', {c}::DOUBLE), 'N/A')"
    plain = lambda c: f"coalesce({c}::VARCHAR, 'N/A')"
    real = {"accuracy", "parse_success_rate", "avg_generation_token_count", "avg_min_logprob", "pct", "answer_min_logprob"}
    cells = lambda *fields: "[" + ", ".join((number if f in real else plain)(f) for f in fields) + "]"

    def part(section: str, source: str, fields: list[str], order: str, limit: int) -> str:
        return f"""SELECT * FROM (SELECT {section} AS section, row_number() OVER (PARTITION BY {section} ORDER BY {order}) AS place, array_to_string({cells(*fields)}, '|') AS cells FROM {source}) WHERE place <= {limit}"""

    name, first = ["category", "subcategory"], "priority_score DESC, category, subcategory"
    parts = [
        part("'overall'", "(SELECT * FROM summary WHERE split = 'overall')", ["n", "accuracy", "parse_success_rate", "avg_generation_token_count"], "n", 1),
        part("'weakest'", "prioritised", [*name, "accuracy", "n"], "accuracy, category, subcategory", report.WEAKEST),
        part("'priorities'", "prioritised", [*name, "priority_score", "priority_reason"], first, report.PRIORITIES),
        part("'groups'", "prioritised", report.GROUP_FIELDS, first, report.GROUPS),
        part("'failures of ' || category", "kinds", ["failure_type", "count", "pct"], "count DESC, failure_type", report.KINDS),
        part("kind || ' cases'", "tagged", ["problem_id", "category", "answer_min_logprob"], "answer_min_logprob, problem_id", report.CASES),
        part("kind || ' counts'", "(SELECT kind, category, count(*) AS count FROM tagged GROUP BY kind, category)", ["category", "count"], "count DESC, category", report.GROUPS),
    ]
    return f"""WITH summary AS ({ORACLE_SQL['summary_rollup']}), prioritised AS ({ORACLE_SQL['failure_priority']}), kinds AS ({ORACLE_SQL['failure_type_counts']}),
  tagged AS (SELECT *, use_ AS kind FROM (SELECT problem_id, category, answer_min_logprob, CASE WHEN is_correct AND answer_min_logprob < -2.0 THEN 'protected' WHEN NOT is_correct AND answer_min_logprob < -3.0 THEN 'replay' END AS use_
    FROM (WITH {duck.JOINED} SELECT * FROM joined)) WHERE use_ IS NOT NULL) {' UNION ALL '.join(parts)}"""


def _report_inputs(spark, sf_dir) -> list:
    unread = ["reasoning_text", "final_answer_text", "lowest_logprob_token", "lowest_logprob_context", "left_context", "right_context"]
    joined = written(_joined(spark, sf_dir).drop(*unread))
    frames = [aggregate.rollup(joined, "category", "subcategory"), aggregate.with_priority(aggregate.failure_groups(joined)),
              aggregate.counts_with_share(failures.all_cases(joined, order="problem_id"), "category", "failure_type", within="category")]
    return [*(written(df) for df in frames), joined.select("problem_id", "category", "is_correct", "answer_min_logprob")]


@query(_report_sql())
def report_lists(spark, sf_dir):
    """Everything that the report shows."""
    return report.lists(*_report_inputs(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


@query(f"""WITH l AS ({_report_sql()}), t AS (
  SELECT section, '| failure_type | count | pct |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || replace(cells, '|', ' | ') || '% |', chr(10) ORDER BY place) AS body FROM l WHERE starts_with(section, 'failures of ') GROUP BY section)
  SELECT replace(section, 'failures of ', '') AS category, '## ' || replace(section, 'failures of ', '') || ': commonest failures' || chr(10) || chr(10) || body AS part FROM t""")
def report_sections(spark, sf_dir):
    """The report's part on each category, cut out of its Markdown."""
    whole = report.recommendation(*_report_inputs(spark, sf_dir))
    parts = [("## " + p).strip() for p in whole.split("\n## ") if p.splitlines()[0].endswith(": commonest failures")]
    return spark.createDataFrame([(p[3:].split(":")[0], p) for p in parts], "category string, part string")


@query("SELECT o_orderkey, o_orderstatus AS split FROM orders WHERE o_orderkey % 3 <> 2 AND coalesce(CASE WHEN o_orderkey % 3 = 1 THEN 'category' END, 'category') = 'category'")
def split_default(spark, sf_dir):
    """Rows without a split are of the categories'; a table without the column is kept whole."""
    k = F.col("o_orderkey")
    split = F.when(k % 3 == 1, "category").when(k % 3 == 2, "overall")
    rows = report.of_split(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), split.alias("split")))
    return report.of_split(rows.select("o_orderkey", F.col("status").alias("Status"))).select("o_orderkey", F.col("Status").alias("split"))


@query(f"WITH {duck.SCORED}, {duck.STATS} SELECT 'fallback' AS kind, problem_id, min_logprob FROM stats UNION ALL SELECT 'inline', problem_id, CASE WHEN problem_id % 2 = 0 THEN -1.5 END FROM scored")
def inline_or_fallback(spark, sf_dir):
    """Log probabilities in the predictions' own column where any row has one, else out of the tokens."""
    rows, tokens = derive.scored(spark, sf_dir).select("problem_id"), derive.tokens(spark, sf_dir)
    out = []
    for kind, own in (("fallback", F.lit(None).cast("double")), ("inline", F.when(F.col("problem_id") % 2 == 0, F.lit(-1.5)))):
        chosen = steps.inline_or(rows.withColumn("min_logprob", own), lambda: logprob.stats(tokens))
        out.append(chosen.select(F.lit(kind).alias("kind"), "problem_id", "min_logprob"))
    return ingest.union(out)

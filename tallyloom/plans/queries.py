"""Queries over the operators, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed, text
from ..functions.transforms import TRANSFORMS
from ..operators import aggregate, classify, failures, gates, joins, logprob, patch, sampling, solver
from . import derive, duck
from .derive import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


# answers and summaries


def _rollup_sql(levels: list[str]) -> str:
    parts = []
    for k in range(len(levels) + 1):
        shown = ", ".join(c if i < k else f"'ALL' AS {c}" for i, c in enumerate(levels))
        group = f" GROUP BY {', '.join(levels[:k])}" if k else ""
        parts.append(
            f"SELECT '{'overall' if not k else levels[k - 1]}' AS split, {shown}, count(*) AS n, count(*) FILTER (is_correct) AS correct, round_even(count(*) FILTER (is_correct)::DOUBLE / count(*), 4) AS accuracy, "
            f"count(*) FILTER (parse_success) AS n_parse_success, round_even(count(*) FILTER (parse_success)::DOUBLE / count(*), 4) AS parse_success_rate, round_even(avg(generation_token_count), 1) AS avg_generation_token_count FROM scored{group}"
        )
    return f"WITH {duck.SCORED} " + " UNION ALL ".join(parts)


@query(_rollup_sql(["category", "subcategory"]))
def summary_rollup(spark, sf_dir):
    return aggregate.rollup(derive.scored(spark, sf_dir), "category", "subcategory")


@query(_rollup_sql(["category"]))
def summary_two_level(spark, sf_dir):
    return aggregate.rollup(derive.scored(spark, sf_dir), "category")


_EXTRACTED = "problem_id, pred_answer, reasoning_text, final_answer_text"


@query(f"WITH {duck.PREDICTIONS}, {duck.extraction('predictions')} SELECT {_EXTRACTED} FROM extracted")
def answer_extract(spark, sf_dir):
    return derive.predictions(spark, sf_dir).withColumn("x", text.extract_answer(F.col("raw_output"))).select("problem_id", "x.*")


@query(f"WITH {duck.PREDICTIONS}, {duck.extraction('predictions', True)} SELECT {_EXTRACTED} FROM extracted")
def answer_extract_truncated(spark, sf_dir):
    return derive.predictions(spark, sf_dir).withColumn("x", text.extract_answer(F.col("raw_output"), F.col("was_truncated"))).select("problem_id", "x.*")


@query(f"WITH {duck.SCORED} SELECT problem_id, upper(regexp_replace(coalesce(pred_answer, ''), '\\s+', '', 'g')) AS normalized, is_correct FROM scored")
def answer_match(spark, sf_dir):
    return derive.scored(spark, sf_dir).select("problem_id", text.normalize_answer(F.col("pred_answer")).alias("normalized"), "is_correct")


@query(f"""WITH {duck.PREDICTIONS}, {duck.extraction('predictions', True)} SELECT problem_id, CASE WHEN pred_answer IS NOT NULL THEN NULL WHEN was_truncated THEN 'truncated_no_boxed'
  WHEN length(trim(raw_output)) < 10 THEN 'empty_output' ELSE 'no_extractable_answer' END AS parse_error_type FROM extracted""")
def parse_error_types(spark, sf_dir):
    rows = derive.predictions(spark, sf_dir).withColumn("x", text.extract_answer(F.col("raw_output"), F.col("was_truncated")))
    return rows.select("problem_id", text.parse_error_type(F.col("x.pred_answer"), F.col("raw_output"), F.col("was_truncated")).alias("parse_error_type"))


@query("""SELECT o_orderkey AS problem_id, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS metric_ok FROM orders""")
def metric_match(spark, sf_dir):
    """Empty; half and nearly twice the tolerance away, at whatever size; equal and different texts."""
    k = F.col("o_orderkey")
    away = lambda d: F.concat(F.lit("$"), (k + F.lit(d)).cast("decimal(20,3)").cast("string"), F.lit("$"))
    pred = F.when(k % 6 == 0, "").when(k % 6 == 1, away(0.005)).when(k % 6 == 2, away(-0.005)).when(k % 6 == 3, away(0.019)).when(k % 6 == 4, "\\text{AB}").otherwise("ab")
    gold = F.when(k % 6 >= 4, "AB").otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("problem_id"), text.metric_match(pred, gold).alias("metric_ok"))


@query("SELECT o_orderkey AS problem_id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_totalprice ELSE 0 END::DOUBLE AS value FROM orders")
def report_numbers(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("ESTIMATED_"), price)).when(k % 4 == 1, "PLACEHOLDER").when(k % 4 == 2, F.concat(F.lit("n/a "), price)).otherwise(price)
    return table(spark, sf_dir, "orders").select(k.alias("problem_id"), text.report_number(raw).alias("value"))


@query(f"WITH {duck.PREDICTIONS} SELECT finish_reason, count(*) AS n, count(*) FILTER (generation_token_count <= 1) AS n_short, avg(generation_token_count) AS avg_tokens FROM predictions GROUP BY finish_reason")
def finish_reasons(spark, sf_dir):
    return aggregate.generation_health(derive.predictions(spark, sf_dir))


@query(f"WITH {duck.PREDICTIONS} SELECT category, avg(generation_token_count / greatest(problem_id % 7 / 10, 0.01)) AS tokens_per_second FROM predictions GROUP BY category")
def throughput(spark, sf_dir):
    rate = aggregate.throughput(F.col("generation_token_count"), F.col("problem_id") % 7 / 10)
    return derive.predictions(spark, sf_dir).groupBy("category").agg(F.avg(rate).alias("tokens_per_second"))


@query(f"""WITH {duck.SCORED} SELECT finish_reason AS split, category, count(*) AS sample_count, count(*) FILTER (is_correct) AS pass_count, count(*) FILTER (parse_success AND NOT is_correct) AS fail_count, count(*) FILTER (NOT parse_success) AS error_count,
  count(*) FILTER (coalesce(parse_error_type = 'empty_output', false)) AS format_failure_count, count(*) FILTER (coalesce(parse_error_type = 'no_extractable_answer', false)) AS extraction_failure_count, count(*) FILTER (is_correct)::DOUBLE / count(*) AS pass_rate FROM scored GROUP BY ALL""")
def measured_summary(spark, sf_dir):
    return aggregate.measured(derive.scored(spark, sf_dir).withColumnRenamed("finish_reason", "split"))


@query(f"WITH {duck.SCORED} SELECT problem_id AS sample_id, category, subcategory, CASE WHEN is_correct THEN 'pass' WHEN parse_success THEN 'fail' ELSE 'error' END AS outcome, pred_answer, gold_answer, parse_error_type, generation_token_count, finish_reason FROM scored")
def measured_rows(spark, sf_dir):
    outcome = F.when(F.col("is_correct"), "pass").when(F.col("parse_success"), "fail").otherwise("error").alias("outcome")
    return derive.scored(spark, sf_dir).select(F.col("problem_id").alias("sample_id"), "category", "subcategory", outcome, "pred_answer", "gold_answer", "parse_error_type", "generation_token_count", "finish_reason")


@query(f"""WITH {duck.SCORED} SELECT 'overall' AS split, 'ALL' AS category, count(*) AS n, sum(is_correct::INT)::BIGINT AS correct, round_even(avg(is_correct::INT::DOUBLE), 4) AS accuracy,
  round_even(avg(parse_success::INT::DOUBLE), 4) AS parse_success_rate, round_even(avg(generation_token_count), 1) AS avg_generation_token_count FROM scored""")
def overall_row(spark, sf_dir):
    fields = ["split", "category", "n", "correct", "accuracy", "parse_success_rate", "avg_generation_token_count"]
    return aggregate.overall_row(aggregate.rollup(derive.scored(spark, sf_dir), "category"), "category").select(*fields)


@query("WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || ' ...[truncated]' ELSE text END AS raw_output, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || ' ...[truncated]' ELSE text END AS reasoning_text FROM t")
def predictions_truncated(spark, sf_dir):
    from ..sources.sinks import shortened

    return shortened(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_output"), F.col("text").alias("reasoning_text"), F.struct("lang").alias("generation_config")))


# transforms, parsing and solving


@query("WITH t AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS l, upper(split_part(p_name, ' ', 2)) AS r FROM part) SELECT p_partkey, " + ", ".join(f"{duck.transform(r, 'l', 'r')} AS {r}" for r in duck.RULES) + " FROM t")
def string_transforms(spark, sf_dir):
    a, b = (F.upper(F.split_part("p_name", F.lit(" "), F.lit(k))) for k in (1, 2))
    return table(spark, sf_dir, "part").select("p_partkey", *(fn(a, b).alias(name) for name, fn in TRANSFORMS.items()))


def _solved(spark, sf_dir) -> DataFrame:
    rows = derive.problems(spark, sf_dir)
    return solver.solve(rows.withColumn("parsed", solver.examples_from_pairs(F.col("examples"))))


_SOLVER = "problem_id, rule_type, normalized_answer, solver_answer, verified, confidence, failure_type, matched_examples, total_examples, solver_notes"


@query(f"WITH {duck.SOLVED} SELECT {_SOLVER} FROM solved")
def rule_solve(spark, sf_dir):
    return _solved(spark, sf_dir).select(*_SOLVER.split(", "))


@query(f"WITH {duck.SOLVED} SELECT problem_id, rule_type, verified, confidence FROM solved WHERE rule_type LIKE 'operator_conditioned_rule:%'")
def rule_conditioned(spark, sf_dir):
    return _solved(spark, sf_dir).where("rule_type like 'operator_conditioned_rule:%'").select("problem_id", "rule_type", "verified", "confidence")


@query(f"WITH {duck.SOLVED} SELECT problem_id, solver_notes, matched_examples FROM solved WHERE failure_type = 'wrong operator rule'")
def rule_best_partial(spark, sf_dir):
    return _solved(spark, sf_dir).where("failure_type = 'wrong operator rule'").select("problem_id", "solver_notes", "matched_examples")


@query(f"WITH {duck.PROBLEMS} SELECT problem_id, nullif(regexp_extract(question, {duck.q(fixed.EXPRESSION)}, 1), '') AS left_operand, nullif(regexp_extract(question, {duck.q(fixed.EXPRESSION)}, 2), '') AS operator, nullif(regexp_extract(question, {duck.q(fixed.EXPRESSION)}, 3), '') AS right_operand FROM problems")
def parse_expression(spark, sf_dir):
    rows = derive.problems(spark, sf_dir).withColumn("e", text.parse_expression(F.col("question")))
    return rows.select("problem_id", F.col("e.left").alias("left_operand"), F.col("e.op").alias("operator"), F.col("e.right").alias("right_operand"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {duck.q(fixed.EXPRESSION)}, 2))), ' ') AS symbols FROM documents")
def operator_symbols(spark, sf_dir):
    return derive.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.operator_symbols(F.col("text")).alias("symbols"))


@query(f"WITH {duck.PROBLEMS} SELECT problem_id, {duck.clean('answer')} AS cleaned FROM problems")
def clean_answer(spark, sf_dir):
    return derive.problems(spark, sf_dir).select("problem_id", text.clean_answer(F.col("answer")).alias("cleaned"))


@query(f"""WITH {duck.PROBLEMS}, shown AS (SELECT *, array_to_string(list_transform(examples, lambda e, i: '  ' || i || '. Input: ' || e.input || ' -> Output: ' || e.output), chr(10)) AS listing FROM problems)
  SELECT problem_id, 'Solve the following problem carefully.' || chr(10) || chr(10) || CASE WHEN len(examples) > 0 THEN 'Examples:' || chr(10) || listing || chr(10) || chr(10) ELSE '' END || 'Question: ' || question || chr(10) || chr(10) || 'Think step by step. Put your final answer inside \\boxed{{}}.' AS prompt FROM shown""")
def prompts(spark, sf_dir):
    return derive.problems(spark, sf_dir).select("problem_id", text.prompt(F.col("question"), F.col("examples")).alias("prompt"))


@query(f"""WITH {duck.PROBLEMS} SELECT problem_id, category, problem_id % 4 = 1 AS current_corpus_included, '{{"answer_chars": ' || length(answer) || ', "examples_chars": ' || length(ex) || ', "question_chars": ' || length(question) || '}}' AS input_output_length,
  array_to_string(list_sort(list_distinct(regexp_extract_all(question || chr(10) || ex || chr(10) || answer, {duck.q(fixed.EXPRESSION)}, 2))), ' ') AS operator_symbols
  FROM (SELECT *, array_to_string(list_transform(examples, lambda e: e.input || ' -> ' || e.output), '; ') AS ex FROM problems) WHERE category IN ('cryptarithm_deduce', 'cryptarithm_guess')""")
def inventory_flagged(spark, sf_dir):
    from ..sources import ingest

    rows = derive.problems(spark, sf_dir).withColumn("examples", F.array_join(F.transform("examples", lambda e: F.concat(e["input"], F.lit(" -> "), e["output"])), "; "))
    corpus = rows.where("problem_id % 4 = 1").select("problem_id")
    return ingest.inventory(rows, corpus).select(F.col("problem_id").cast("long").alias("problem_id"), "category", "current_corpus_included", "input_output_length", "operator_symbols")


def _samples(spark, sf_dir) -> DataFrame:
    said = solver.reasoning_text(category=F.col("category"), question=F.col("question"), examples=F.col("parsed"), rule=F.col("rule_type"), solver_answer=F.col("solver_answer"))
    return _solved(spark, sf_dir).withColumn("reasoning_text", said)


@query(f"WITH {duck.COT} SELECT problem_id, reasoning_text FROM cot WHERE verified")
def cot_text(spark, sf_dir):
    return _samples(spark, sf_dir).where("verified").select("problem_id", "reasoning_text")


_FLAT = "problem_id, category, user_role, user_content, assistant_role, assistant_content, answer, source, rule_type, verified, mask_policy"


@query(f"""WITH {duck.COT} SELECT problem_id::VARCHAR AS problem_id, category, 'user' AS user_role, question AS user_content, 'assistant' AS assistant_role, reasoning_text AS assistant_content, solver_answer AS answer, 'cryptarithm_solver_verified_cot' AS source, rule_type, true AS verified, 'final_answer_and_rule_application' AS mask_policy
  FROM cot WHERE verified AND category IN ('cryptarithm_deduce', 'cryptarithm_guess') AND solver_answer <> ''""")
def patch_build(spark, sf_dir):
    rows, _ = patch.build(_samples(spark, sf_dir).withColumn("problem_id", F.col("problem_id").cast("string")), order="problem_id")
    m = lambda k, c: F.get("messages", F.lit(k))[c]
    return rows.select("problem_id", "category", m(0, "role").alias("user_role"), m(0, "content").alias("user_content"), m(1, "role").alias("assistant_role"), m(1, "content").alias("assistant_content"), "answer", "metadata.source", "metadata.rule_type", "metadata.verified", "metadata.mask_policy")


@query(f"""WITH {duck.COT} SELECT problem_id, array_to_string(list_filter([CASE WHEN NOT verified THEN 'sample.verified must be true' END, CASE WHEN category NOT IN ('cryptarithm_deduce', 'cryptarithm_guess') THEN 'unexpected category ''' || category || '''' END,
  CASE WHEN question = '' THEN 'missing question' END, CASE WHEN solver_answer = '' THEN 'missing solver_answer' END, CASE WHEN reasoning_text = '' THEN 'missing reasoning_text' END], lambda x: x IS NOT NULL), '; ') AS errors FROM cot
  WHERE NOT verified OR category NOT IN ('cryptarithm_deduce', 'cryptarithm_guess') OR solver_answer = ''""")
def patch_rejected(spark, sf_dir):
    _, bad = patch.build(_samples(spark, sf_dir), order="problem_id")
    return bad.select("problem_id", F.array_join("errors", "; ").alias("errors"))


@query("""WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 THEN 'unexpected category ''chat''' END, CASE WHEN len(ms) <> 2 THEN 'expected two chat messages' END,
    CASE WHEN len(ms) = 2 AND ms[1].role <> 'user' THEN 'message 1 role must be ''user''' END, CASE WHEN len(ms) = 2 AND coalesce(ms[1].content, '') = '' THEN 'message 1 missing content' END,
    CASE WHEN len(ms) = 2 AND ms[2].role <> 'assistant' THEN 'message 2 role must be ''assistant''' END, CASE WHEN len(ms) = 2 AND coalesce(ms[2].content, '') = '' THEN 'message 2 missing content' END,
    CASE WHEN conv_id % 5 = 0 THEN 'metadata.verified must be true' END], lambda x: x IS NOT NULL), '; ') AS errors FROM m""")
def patch_validate(spark, sf_dir):
    rows = derive.chats(spark, sf_dir).select("conv_id", F.when(F.col("conv_id") % 3 == 0, "cryptarithm_guess").otherwise("chat").alias("category"), F.lit("x").alias("answer"), "messages", F.struct((F.col("conv_id") % 5 != 0).alias("verified")).alias("metadata"))
    return rows.select("conv_id", F.array_join(patch.record_errors(), "; ").alias("errors"))


@query(f"WITH {duck.SOLVED} SELECT category, count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (verified)::DOUBLE / count(*) AS ratio FROM solved GROUP BY category")
def coverage_by_category(spark, sf_dir):
    return aggregate.coverage(_solved(spark, sf_dir))


_COUNTER = "count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(problem_id)) AS rank"


@query(f"WITH {duck.SOLVED} SELECT CASE WHEN failure_type = '' THEN 'verified' ELSE failure_type END AS failure_type, {_COUNTER} FROM solved GROUP BY 1")
def failure_labels(spark, sf_dir):
    return aggregate.label_counts(_solved(spark, sf_dir), "failure_type", empty="verified", order="problem_id")


@query(f"WITH {duck.SOLVED}, n AS (SELECT solver_notes, {_COUNTER} FROM solved WHERE NOT verified GROUP BY 1) SELECT * FROM n WHERE rank <= 10")
def first_notes(spark, sf_dir):
    return aggregate.label_counts(_solved(spark, sf_dir).where("not verified"), "solver_notes", empty="", order="problem_id", most=10)


# classification and sampling

_C1 = "category, subcategory, confidence, rule, matched_keywords, manual_review_required"


@query(f"WITH source AS (SELECT doc_id AS key, '' AS label, ' ' || trim({duck.ASCII_TEXT}) || ' ' AS t FROM documents), {duck.KEYWORDS} SELECT key AS doc_id, {_C1} FROM classified")
def category_map_c1(spark, sf_dir):
    rows = classify.by_keywords(derive.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), category=F.lit(""), question=F.col("text"), examples=F.lit(""))
    return rows.select("doc_id", "c1.*")


@query(f"WITH source AS (SELECT problem_id AS key, 'of ' || category AS label, 'of ' || category || ' ' || raw_output || ' ' || question AS t FROM predictions), {duck.KEYWORDS} SELECT key AS problem_id, {_C1} FROM classified".replace("WITH ", f"WITH {duck.PREDICTIONS}, ", 1))
def category_map_outputs(spark, sf_dir):
    rows = classify.by_keywords(derive.predictions(spark, sf_dir), category=F.concat(F.lit("of "), "category"), question=F.col("raw_output"), examples=F.col("question"))
    return rows.select("problem_id", "c1.*")


@query(f"WITH {duck.PROBLEMS}, source AS (SELECT problem_id AS key, category AS label, category || ' ' || question || ' ' AS t FROM problems), {duck.KEYWORDS} SELECT key AS problem_id, {_C1} FROM classified")
def category_map_explicit(spark, sf_dir):
    rows = classify.by_keywords(derive.problems(spark, sf_dir), category=F.col("category"), question=F.col("question"), examples=F.lit(""))
    return rows.select("problem_id", "c1.*")


@query(f"WITH t AS (SELECT doc_id, {duck.ASCII_TEXT} AS t FROM documents) SELECT doc_id, {duck.SINGLE('t')} AS category FROM t")
def category_c2(spark, sf_dir):
    return derive.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", classify.by_single_pattern(F.col("text")).alias("category"))


def _phrases_sql(source: str) -> str:
    words, low = f"regexp_matches(t, {duck.q(fixed.WORD_SUM)})", "lower(t)"
    pairs = [
        (duck.any_part(low, fixed.LETTER_PHRASES), "'cryptarithmetic'", f"CASE WHEN {words} THEN 'word_arithmetic' ELSE 'digit_assignment' END"), (f"{words} AND {duck.any_part(low, fixed.LETTER_HINTS)}", "'cryptarithmetic'", "'word_arithmetic'"),
        (duck.any_part(low, fixed.BIT_PHRASES), "'bit_manipulation'", f"CASE WHEN regexp_matches(t, {duck.q(fixed.BITS_ARROW)}) THEN 'pattern_discovery' ELSE 'single_operation' END"), (f"regexp_matches(t, {duck.q(fixed.BITS_TO_BITS)})", "'bit_manipulation'", "'pattern_discovery'"),
        (duck.any_part(low, fixed.NUMERAL_PHRASES), "'numeral_conversion'", f"CASE WHEN contains({low}, 'hex') THEN 'hex_decimal' WHEN contains({low}, 'oct') THEN 'octal_decimal' ELSE 'cross_base' END"),
    ]
    return f"SELECT key, CASE {' '.join(f'WHEN {c} THEN {a}' for c, a, _ in pairs)} ELSE 'other' END AS category, CASE {' '.join(f'WHEN {c} THEN {s}' for c, _, s in pairs)} ELSE 'unknown' END AS subcategory FROM {source}"


@query(f"WITH {duck.PREDICTIONS}, s AS (SELECT problem_id AS key, raw_output || ' ' || CASE problem_id % 4 WHEN 0 THEN 'AB + CD with unique digits' WHEN 1 THEN '01101 -> 10010' WHEN 2 THEN 'base 16 radix' ELSE question END AS t FROM predictions) " + _phrases_sql("s").replace("SELECT key", "SELECT key AS problem_id", 1))
def category_c3(spark, sf_dir):
    tail = F.coalesce(derive.pick(F.col("problem_id") % 4, ["AB + CD with unique digits", "01101 -> 10010", "base 16 radix"]), F.col("question"))
    return derive.predictions(spark, sf_dir).withColumn("c", classify.by_phrases(F.concat("raw_output", F.lit(" "), tail))).select("problem_id", "c.*")


@query(f"WITH t AS (SELECT {duck.SINGLE(duck.ASCII_TEXT)} AS category FROM documents) SELECT category, count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM t GROUP BY category")
def category_distribution(spark, sf_dir):
    return aggregate.counts_with_share(category_c2(spark, sf_dir), "category")


_DRAW = "(doc_id * 7919) % 10007"
_QUOTA = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in fixed.SAMPLE_QUOTAS.items()) + " ELSE 0 END"


@query(f"""WITH t AS (SELECT doc_id, {duck.SINGLE(duck.ASCII_TEXT)} AS category FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_DRAW}, doc_id) AS k FROM t),
  p AS (SELECT doc_id, category, CASE WHEN k <= {_QUOTA} THEN 'quota' ELSE 'backfill' END AS drawn FROM r), o AS (SELECT *, row_number() OVER (ORDER BY drawn DESC, doc_id) AS place FROM p) SELECT doc_id, category, drawn FROM o WHERE place <= 200""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(category_c2(spark, sf_dir), fixed.SAMPLE_QUOTAS, key="doc_id", draw=F.col("doc_id") * 7919 % 10007)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def shuffled_sample(spark, sf_dir):
    return sampling.shuffled_prefix(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, sf_dir):
    return sampling.prefix(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


@query(f"""WITH q AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang, unnest([70, 40, 40, 50]) AS quota), r AS (SELECT doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY {_DRAW}, doc_id) AS k, coalesce(quota, 0) AS quota FROM documents d LEFT JOIN q ON q.lang = d.lang),
  o AS (SELECT doc_id, lang, CASE WHEN k <= quota THEN 'quota' ELSE 'backfill' END AS drawn, row_number() OVER (ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END, doc_id) AS place FROM r) SELECT doc_id, lang AS stratum, 'diagnostic' AS tier, drawn FROM o WHERE place <= 200""")
def tiered_set(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.tiered(rows, "diagnostic", ["en", "de", "fr", "es"], key="doc_id", category="lang", draw=F.col("doc_id") * 7919 % 10007).select("doc_id", F.col("lang").alias("stratum"), F.lit("diagnostic").alias("tier"), "drawn")


# joins and lookups


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unfinished(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


_LAST = "SELECT l_orderkey, arg_max({'l_shipdate': l_shipdate, 'l_partkey': l_partkey, 'l_quantity': l_quantity}, ord) AS x FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity) AS ord FROM lineitem) GROUP BY l_orderkey"


def _last_lines(spark, sf_dir) -> DataFrame:
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_quantity", order.alias("ord"))


@query(f"SELECT l_orderkey, x.l_partkey AS l_partkey, x.l_quantity AS l_quantity FROM ({_LAST})")
def lookup_keep_last(spark, sf_dir):
    return joins.keep_last(_last_lines(spark, sf_dir), "l_orderkey", "ord").select("l_orderkey", "l_partkey", "l_quantity")


@query("WITH m AS (SELECT k, arg_max(category, ord) AS category FROM (SELECT p_partkey % 500 AS k, p_partkey AS ord, p_type AS category FROM part) GROUP BY k) SELECT p.p_partkey AS problem_id, coalesce(m.category, 'other') AS category, coalesce(NULL, 'unknown') AS subcategory FROM part p LEFT JOIN m ON m.k = p.p_partkey")
def category_left_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mapped = part.select((F.col("p_partkey") % 500).alias("problem_id"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.col("p_partkey").alias("ord"))
    return joins.lookup(part.select(F.col("p_partkey").alias("problem_id")), mapped, "problem_id", order="ord", defaults={"category": "other", "subcategory": "unknown"})


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), user_id::VARCHAR) AS name, CASE WHEN value = 0 THEN 'row_' || event_id WHEN event_id % 4 = 0 THEN 'row_' || event_id ELSE event_id::VARCHAR END AS id FROM events")
def id_resolution(spark, sf_dir):
    row = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    own = F.when((F.col("value") == 0) | (F.col("event_id") % 4 == 0), 0).otherwise(F.col("event_id"))
    return row.select("event_id", joins.first_present(kind, F.col("user_id")).alias("name"), joins.first_true(own, order=F.col("event_id")).alias("id"))


@query("SELECT DISTINCT user_id::VARCHAR AS id FROM events WHERE event_type <> 'purchase'")
def distinct_ids(spark, sf_dir):
    from ..sources import ingest

    return ingest.distinct_ids(table(spark, sf_dir, "events").where("event_type <> 'purchase'").select(F.lit("").alias("problem_id"), F.col("user_id").alias("id")))


@query("SELECT item_id::VARCHAR AS problem_id, text AS question, 'benchmark' AS source FROM benchmark UNION ALL SELECT doc_id::VARCHAR, text, source FROM documents")
def union_sources(spark, sf_dir):
    from ..sources import ingest

    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("problem_id"), F.col("text").alias("question"), F.lit("benchmark").alias("source"))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("problem_id"), F.col("text").alias("question"), "source", "lang")
    return ingest.union([a, b]).select("problem_id", "question", "source")


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, count(DISTINCT (props->>'k')::BIGINT) AS n_distinct FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.countDistinct(k).alias("n_distinct"))


# log probabilities


def _stats(spark, sf_dir) -> DataFrame:
    return logprob.stats(derive.tokens(spark, sf_dir))


_LP = "problem_id, min_logprob, mean_logprob, answer_min_logprob, answer_mean_logprob, low_conf_token_count, lowest_logprob_token, lowest_logprob_context, answer_low_conf_token_count, left_context, right_context"


@query(f"WITH {duck.STATS} SELECT {_LP} FROM stats")
def logprob_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(*_LP.split(", "))


@query(f"WITH {duck.STATS} SELECT problem_id, answer_start::INT AS answer_start FROM stats")
def answer_segment(spark, sf_dir):
    return derive.tokens(spark, sf_dir).select("problem_id", logprob.answer_start(F.col("tokens")).alias("answer_start"))


@query("""WITH t AS (SELECT l_orderkey, floor(l_quantity / 26) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS i FROM lineitem),
  f AS (SELECT * FROM t WHERE i <= 20), g AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey, v ORDER BY i) AS island FROM f), r AS (SELECT l_orderkey, count(*) AS run FROM g GROUP BY l_orderkey, v, island)
  SELECT l_orderkey AS problem_id, max(run)::INT AS longest, max(run) >= 4 AS degenerate FROM r GROUP BY l_orderkey""")
def repeat_runs(spark, sf_dir):
    rows = derive.tokens(spark, sf_dir).withColumn("coarse", F.transform("token_logprobs", lambda x: F.floor(-x * 10 / 26).cast("double")))
    return rows.select("problem_id", logprob.longest_run(F.col("coarse")).alias("longest"), logprob.degenerate(F.col("coarse"), run=4).alias("degenerate"))


def _joined(spark, sf_dir) -> DataFrame:
    own = derive.scored(spark, sf_dir)
    return own.join(_stats(spark, sf_dir).drop("token_logprobs", "tokens"), "problem_id", "left")


@query(f"WITH {duck.JOINED} SELECT category, count(*) AS n, avg(min_logprob) AS avg_min_logprob, avg(mean_logprob) AS avg_mean_logprob, count(*) FILTER (is_correct)::DOUBLE / count(*) AS accuracy FROM joined WHERE min_logprob IS NOT NULL GROUP BY category")
def logprob_by_category(spark, sf_dir):
    return aggregate.logprob_means(_joined(spark, sf_dir))


_BRITTLE = "problem_id, category, is_correct, min_logprob"


@query(f"""WITH {duck.JOINED}, b AS (SELECT {_BRITTLE} FROM joined WHERE min_logprob IS NOT NULL), l AS (
  SELECT *, 'overall' AS list, row_number() OVER (ORDER BY min_logprob, problem_id) AS rank FROM b UNION ALL SELECT *, category, row_number() OVER (PARTITION BY category ORDER BY min_logprob, problem_id) FROM b
  UNION ALL SELECT *, CASE WHEN is_correct THEN 'correct' ELSE 'incorrect' END, row_number() OVER (PARTITION BY is_correct ORDER BY min_logprob, problem_id) FROM b) SELECT * FROM l WHERE rank <= 20""")
def brittle_ranked(spark, sf_dir):
    return logprob.ranked(_joined(spark, sf_dir).select(*_BRITTLE.split(", ")), 20, "min_logprob", "problem_id")


@query(f"WITH {duck.JOINED} SELECT problem_id, CASE WHEN is_correct THEN 'protect' ELSE 'replay' END AS use, answer_min_logprob FROM joined WHERE (is_correct AND answer_min_logprob < -2.0) OR (NOT is_correct AND answer_min_logprob < -3.0)")
def protected_and_replay(spark, sf_dir):
    lp, ok = F.col("answer_min_logprob"), F.col("is_correct")
    kept = (ok & (lp < fixed.LOW_LOGPROB)) | (~ok & (lp < fixed.BOOST_LOGPROB))
    return _joined(spark, sf_dir).where(kept).select("problem_id", F.when(ok, "protect").otherwise("replay").alias("use"), "answer_min_logprob")


@query(f"WITH {duck.JOINED}, r AS (SELECT category, count(*) AS n FROM joined WHERE NOT is_correct AND answer_min_logprob < -3.0 AND problem_id % 10 <> 0 GROUP BY category) SELECT category, n, least(n::DOUBLE / sum(n) OVER (), 0.25) AS weight FROM r")
def replay_manifest(spark, sf_dir):
    rows = _joined(spark, sf_dir).where(~F.col("is_correct") & (F.col("answer_min_logprob") < fixed.BOOST_LOGPROB))
    held_out = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("problem_id"))
    counted = rows.join(held_out, "problem_id", "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("weight", gates.replay_weight(F.col("n"), F.sum("n").over(W.partitionBy())))


# failures

_RANKED = "row_number() OVER (ORDER BY priority_score DESC, accuracy, category, subcategory) AS rank"


def _prioritised(spark, sf_dir) -> DataFrame:
    return aggregate.with_priority(aggregate.failure_groups(_joined(spark, sf_dir)))


@query(f"WITH {duck.PRIORITISED} SELECT *, {_RANKED} FROM prioritised")
def failure_priority(spark, sf_dir):
    return _prioritised(spark, sf_dir)


@query(f"WITH {duck.PRIORITISED}, r AS (SELECT category, subcategory, priority_score, {_RANKED} FROM prioritised) SELECT * FROM r WHERE rank <= 5")
def topk_failures(spark, sf_dir):
    return _prioritised(spark, sf_dir).where("rank <= 5").select("category", "subcategory", "priority_score", "rank")


@query(f"WITH {duck.SCORED}, a AS (SELECT category, count(*) FILTER (is_correct)::DOUBLE / count(*) AS accuracy FROM scored GROUP BY category), r AS (SELECT *, row_number() OVER (ORDER BY accuracy, category) AS rank FROM a) SELECT * FROM r WHERE rank <= 3")
def weakest_categories(spark, sf_dir):
    grouped = derive.scored(spark, sf_dir).groupBy("category").agg((F.count_if("is_correct").cast("double") / F.count(F.lit(1))).alias("accuracy"))
    return aggregate.top(grouped, 3, "accuracy", "category")


@query(f"WITH {duck.SCORED}, a AS (SELECT category, count(*) FILTER (is_correct)::DOUBLE / count(*) AS accuracy, min(problem_id) AS first FROM scored GROUP BY category) SELECT category, accuracy FROM a ORDER BY accuracy, first LIMIT 1")
def worst_category_argmin(spark, sf_dir):
    grouped = derive.scored(spark, sf_dir).groupBy("category").agg((F.count_if("is_correct").cast("double") / F.count(F.lit(1))).alias("accuracy"), F.min("problem_id").alias("first"))
    return aggregate.worst(grouped, "accuracy", "category", "first")


@query(f"WITH {duck.JOINED}, {duck.cases('cryptarithm')} SELECT * FROM cryptarithm_cases")
def failure_cases_cryptarithm(spark, sf_dir):
    return failures.cases(_joined(spark, sf_dir), "cryptarithm", order="problem_id", include_fragile=True)


@query(f"WITH {duck.JOINED}, {duck.cases('bit_manipulation')} SELECT * FROM bit_manipulation_cases")
def failure_cases_bit(spark, sf_dir):
    return failures.cases(_joined(spark, sf_dir), "bit_manipulation", order="problem_id")


@query(f"WITH {duck.JOINED}, {duck.cases('numeral_conversion')} SELECT * FROM numeral_conversion_cases")
def failure_cases_numeral(spark, sf_dir):
    return failures.cases(_joined(spark, sf_dir), "numeral_conversion", order="problem_id")


def _all_cases(spark, sf_dir) -> DataFrame:
    return failures.all_cases(_joined(spark, sf_dir), order="problem_id")


_PCT = "count(*) AS count, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 1)::DOUBLE AS pct"


@query(f"WITH {duck.ALL_CASES} SELECT category, failure_type, {_PCT} FROM all_cases GROUP BY category, failure_type")
def failure_type_counts(spark, sf_dir):
    return aggregate.counts_with_share(_all_cases(spark, sf_dir), "category", "failure_type", within="category")


@query(f"WITH {duck.ALL_CASES}, c AS (SELECT category, failure_type, count(*) AS count FROM all_cases GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, failure_type) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def topk_failure_types(spark, sf_dir):
    counted = _all_cases(spark, sf_dir).groupBy("category", "failure_type").agg(F.count(F.lit(1)).alias("count"))
    return aggregate.top(counted, 5, F.desc("count"), "failure_type", by="category")


_BOXED = "regexp_matches(raw_output, '\\\\boxed\\{')"
_NOTEBOOK = f"""CASE WHEN is_correct THEN 'correct' WHEN NOT parse_success THEN 'parse_fail' WHEN finish_reason = 'length' THEN 'timeout'
  WHEN category = 'cryptarithmetic' THEN CASE WHEN regexp_matches(raw_output, '[A-Z]\\s*[=:]\\s*\\d|\\d\\s*[=:]\\s*[A-Z]') THEN 'wrong_digit_assignment' WHEN {_BOXED} THEN 'wrong_answer_boxed' ELSE 'no_systematic_attempt' END
  WHEN category = 'bit_manipulation' THEN CASE WHEN regexp_matches(raw_output, '\\b[01]{{4,}}\\b') THEN 'wrong_binary_result' WHEN {_BOXED} THEN 'wrong_answer_boxed' ELSE 'no_binary_analysis' END
  WHEN category = 'numeral_conversion' THEN CASE WHEN {_BOXED} THEN 'wrong_converted_value' ELSE 'no_conversion_attempt' END ELSE 'wrong_answer' END"""
_RENAMED = f"{duck.SCORED}, renamed AS (SELECT * REPLACE (CASE WHEN category = 'cryptarithm' THEN 'cryptarithmetic' ELSE category END AS category) FROM scored), f4 AS (SELECT problem_id, category, subcategory, {_NOTEBOOK} AS failure_type FROM renamed)"


def _notebook(spark, sf_dir) -> DataFrame:
    renamed = derive.scored(spark, sf_dir).withColumn("category", F.when(F.col("category") == "cryptarithm", "cryptarithmetic").otherwise(F.col("category")))
    return failures.notebook(renamed).select("problem_id", "category", "subcategory", "failure_type")


@query(f"WITH {_RENAMED} SELECT * FROM f4")
def failure_notebook(spark, sf_dir):
    return _notebook(spark, sf_dir)


@query(f"WITH {_RENAMED} SELECT category, failure_type, {_PCT} FROM f4 GROUP BY category, failure_type")
def failure_share_in_category(spark, sf_dir):
    return aggregate.counts_with_share(_notebook(spark, sf_dir), "category", "failure_type", within="category")


# spec-derived comparisons


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = derive.scored(spark, sf_dir)
    after = rows.where("problem_id % 97 <> 0").withColumns({"is_correct": F.col("is_correct") | (F.col("problem_id") % 9 == 0), "pred_answer": F.when(F.col("problem_id") % 9 == 0, F.col("gold_answer")).otherwise(F.col("pred_answer"))})
    return rows.where("problem_id % 89 <> 0"), after


_RUNS = f"{duck.SCORED}, pre AS (SELECT * FROM scored WHERE problem_id % 89 <> 0), post AS (SELECT * REPLACE (is_correct OR problem_id % 9 = 0 AS is_correct, CASE WHEN problem_id % 9 = 0 THEN gold_answer ELSE pred_answer END AS pred_answer) FROM scored WHERE problem_id % 97 <> 0)"


@query(f"""WITH {_RUNS} SELECT coalesce(a.problem_id, b.problem_id) AS problem_id, a.pred_answer AS pre_answer, b.pred_answer AS post_answer, a.is_correct AS pre_correct, b.is_correct AS post_correct,
  CASE WHEN a.is_correct IS NULL OR b.is_correct IS NULL THEN 'id_drift' WHEN a.is_correct AND b.is_correct THEN 'stable_pass' WHEN NOT a.is_correct AND NOT b.is_correct THEN 'stable_fail' WHEN a.is_correct THEN 'regression' ELSE 'improvement' END AS delta_label FROM pre a FULL JOIN post b ON a.problem_id = b.problem_id""")
def prepost_delta(spark, sf_dir):
    before, after = _runs(spark, sf_dir)
    return joins.compare_runs(before, after, "problem_id")


_ACC = "SELECT category, count(*) AS n, count(*) FILTER (is_correct)::DOUBLE / count(*) AS accuracy FROM"


@query(f"""WITH {_RUNS}, a AS ({_ACC} pre GROUP BY category), b AS ({_ACC} post WHERE category <> 'cipher' GROUP BY category), c AS (SELECT coalesce(a.category, b.category) AS category, a.n AS baseline_n, b.n AS candidate_n, a.accuracy AS baseline_accuracy, b.accuracy AS candidate_accuracy, b.accuracy - a.accuracy AS delta FROM a FULL JOIN b ON a.category = b.category)
  SELECT *, CASE WHEN delta IS NULL THEN 'missing' WHEN least(baseline_n, candidate_n) < 30 THEN 'insufficient' WHEN delta <= -0.02 THEN 'reject' WHEN delta >= 0.01 THEN 'promote' ELSE 'hold' END AS status FROM c""")
def gate_decision(spark, sf_dir):
    before, after = _runs(spark, sf_dir)
    mean = lambda df: df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), (F.count_if("is_correct").cast("double") / F.count(F.lit(1))).alias("accuracy"))
    return gates.decide(gates.compare_categories(mean(before), mean(after.where("category <> 'cipher'"))))


_NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id FROM documents WHERE {_NORMAL} IN (SELECT {_NORMAL} FROM documents WHERE doc_id % 3 = 0) AND doc_id % 3 <> 0")
def holdout_leak(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gates.leaks(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")).select("doc_id")

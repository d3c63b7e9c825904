"""Queries over the operators that follow from the specifications, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import aggregate, classify, failures, gates, logprob, patch, sampling, solver
from . import derive, duck, queries
from .derive import table
from .queries import query

_SPLIT = "CASE problem_id % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'diagnostic' ELSE 'promotion' END"
_RUN = "problem_id % 9 = 0"


def _split(key: str = "problem_id"):
    return derive.pick(F.col(key) % 3, ["quick", "diagnostic", "promotion"])


def _modes(spark, sf_dir) -> DataFrame:
    """Scored samples with log probabilities, kind of failure, what a conversion did to them, and their failure modes."""
    rows = failures.labelled(queries._joined(spark, sf_dir))
    after = F.col("is_correct") | (F.col("problem_id") % 9 == 0)
    before = F.col("is_correct") | (F.col("problem_id") % 8 == 0)
    label = F.when(before & after, "stable_pass").when(~before & ~after, "stable_fail").when(before, "regression").otherwise("improvement")
    rows = rows.withColumns({"delta_label": label, "diagnostic_correct": F.col("problem_id") % 2 == 0, "conversion_label": F.when(F.col("problem_id") % 2 == 0, "pre").otherwise("post")})
    return gates.with_failure_modes(rows)


# the labels by the taxonomy's names, in the order in which they are looked for
_MODES = f"""{duck.ALL_CASES}, labelled AS (
  SELECT j.*, c.failure_type, CASE WHEN (is_correct0 OR p8) AND (is_correct0 OR p9) THEN 'stable_pass' WHEN NOT (is_correct0 OR p8) AND NOT (is_correct0 OR p9) THEN 'stable_fail' WHEN is_correct0 OR p8 THEN 'regression' ELSE 'improvement' END AS delta_label
  FROM (SELECT *, is_correct AS is_correct0, problem_id % 8 = 0 AS p8, problem_id % 9 = 0 AS p9 FROM joined) j LEFT JOIN (SELECT problem_id, failure_type FROM all_cases) c ON c.problem_id = j.problem_id
), listed AS (
  SELECT *, CASE WHEN is_correct THEN [] ELSE list_filter([
    CASE WHEN parse_error_type IN ('empty_output', 'truncated_no_boxed') OR failure_type = 'answer_format_error' THEN 'FORMAT_FAILURE' END,
    CASE WHEN parse_error_type = 'no_extractable_answer' OR failure_type = 'final_parse_error' THEN 'EXTRACTION_FAILURE' END,
    CASE WHEN delta_label = 'regression' THEN 'PREPOST_CONVERSION_REGRESSION' END,
    CASE WHEN failure_type IN ('xor_error', 'and_error', 'or_error', 'shift_error', 'mask_error', 'hallucinated_rule') THEN 'OPERATOR_CONFUSION' END,
    CASE WHEN failure_type IN ('digit_order_error', 'carry_error', 'mapping_conflict', 'leading_zero_error') THEN 'POSITIONAL_MISMATCH' END,
    CASE WHEN category = 'bit_manipulation' THEN 'BIT_RULE_FAILURE' END,
    CASE WHEN category IN ('cipher', 'gravity', 'numeral_conversion', 'unit_conversion') THEN 'EASY_TASK_REGRESSION' END,
    CASE WHEN min_logprob < -2.0 THEN 'LOW_LOGPROB_COLLAPSE' END,
    CASE WHEN problem_id % 2 = 0 THEN 'OVERFITTING_TO_DIAGNOSTIC' END], lambda x: x IS NOT NULL) END AS met FROM labelled
), modes AS (
  SELECT *, CASE WHEN NOT is_correct THEN coalesce(met[1], 'UNKNOWN') END AS failure_mode_primary, met[2] AS failure_mode_secondary FROM listed
)"""


@query(f"WITH {_MODES} SELECT problem_id, failure_mode_primary, failure_mode_secondary FROM modes")
def failure_modes(spark, sf_dir):
    return _modes(spark, sf_dir).select("problem_id", "failure_mode_primary", "failure_mode_secondary")


@query(f"""WITH {_MODES}, acc AS (SELECT category AS c, count(*) FILTER (is_correct)::DOUBLE / count(*) AS a FROM scored GROUP BY category)
  SELECT problem_id AS sample_id, {_SPLIT} AS split_name, category, CASE WHEN a >= 0.85 THEN 'easy' WHEN a >= 0.70 THEN 'medium' ELSE 'hard' END AS difficulty_bucket, failure_mode_primary, failure_mode_secondary,
    delta_label IN ('regression', 'improvement') AS conversion_sensitive_flag,
    CASE WHEN delta_label IN ('regression', 'improvement') THEN 'conversion_sensitive' WHEN coalesce(min_logprob < -2.0, false) THEN 'brittle' WHEN failure_mode_primary IS NOT NULL THEN 'failed' ELSE 'coverage' END AS inclusion_reason
  FROM modes JOIN acc ON c = category""")
def category_manifest(spark, sf_dir):
    rows = _modes(spark, sf_dir)
    accuracy = derive.scored(spark, sf_dir).groupBy("category").agg((F.count_if("is_correct").cast("double") / F.count(F.lit(1))).alias("category_accuracy"))
    return gates.manifest(rows.join(accuracy, "category"), split=_split()).select(*fixed.MANIFEST_FIELDS)


@query(f"""WITH {duck.SCORED} SELECT problem_id AS sample_id, {_SPLIT} AS split_name, category, CASE WHEN pred_answer IS NULL THEN 'no_answer' ELSE 'answered' END AS baseline_prediction_status, is_correct AS baseline_correctness,
  coalesce(parse_error_type, '') IN ('empty_output', 'truncated_no_boxed') AS format_failure_flag, coalesce(parse_error_type, '') = 'no_extractable_answer' AS extraction_failure_flag,
  CASE finish_reason WHEN 'length' THEN 'truncated' WHEN 'eos' THEN 'completed' ELSE 'unknown' END AS runtime_status,
  concat_ws('; ', nullif(parse_error_type, ''), CASE WHEN finish_reason = 'length' THEN 'hit the token limit' END) AS notes FROM scored""")
def measured_samples(spark, sf_dir):
    return gates.measured_samples(derive.scored(spark, sf_dir), split=_split()).select(*fixed.MEASURED_FIELDS)


@query(f"""WITH {_MODES} SELECT problem_id AS sample_id, {_SPLIT} AS split_name, category, is_correct AS correctness, min_logprob AS min_logprob_value, lowest_logprob_token AS min_logprob_token, left_context AS local_context_left,
  right_context AS local_context_right, failure_mode_primary, failure_mode_secondary, CASE WHEN problem_id % 2 = 0 THEN 'pre' ELSE 'post' END AS pre_or_post_conversion_label FROM modes WHERE min_logprob IS NOT NULL""")
def fragile_samples(spark, sf_dir):
    return gates.fragile_samples(_modes(spark, sf_dir), split=_split()).select(*fixed.FRAGILE_FIELDS)


@query(f"""WITH {duck.JOINED}, pre AS (SELECT * FROM joined WHERE problem_id % 89 <> 0), post AS (SELECT * REPLACE (is_correct OR problem_id % 9 = 0 AS is_correct, min_logprob - 1 AS min_logprob) FROM joined WHERE problem_id % 97 <> 0),
  paired AS (SELECT coalesce(a.problem_id, b.problem_id) AS problem_id, coalesce(a.category, b.category) AS category, a.is_correct AS x, b.is_correct AS y, a.problem_id IS NOT NULL AS has_a, b.problem_id IS NOT NULL AS has_b,
    a.parse_error_type AS pa, b.parse_error_type AS pb, a.min_logprob AS la, b.min_logprob AS lb FROM pre a FULL JOIN post b ON a.problem_id = b.problem_id)
  SELECT problem_id AS sample_id, {_SPLIT} AS split_name, category, CASE WHEN x THEN 'pass' WHEN NOT x THEN 'fail' END AS baseline_pre_conversion_result, CASE WHEN y THEN 'pass' WHEN NOT y THEN 'fail' END AS baseline_post_conversion_result,
    CASE WHEN x IS NULL OR y IS NULL THEN 'id_drift' WHEN x AND y THEN 'stable_pass' WHEN NOT x AND NOT y THEN 'stable_fail' WHEN x THEN 'regression' ELSE 'improvement' END AS delta_label,
    CASE WHEN has_a THEN coalesce(pa, '') IN ('empty_output', 'truncated_no_boxed') END AS format_failure_pre, CASE WHEN has_b THEN coalesce(pb, '') IN ('empty_output', 'truncated_no_boxed') END AS format_failure_post,
    la AS min_logprob_pre, lb AS min_logprob_post, coalesce(la < -2.0, false) OR coalesce(lb < -2.0, false) AS brittle_subset_flag FROM paired""")
def conversion_deltas(spark, sf_dir):
    rows = queries._joined(spark, sf_dir)
    after = rows.where("problem_id % 97 <> 0").withColumns({"is_correct": F.col("is_correct") | (F.col("problem_id") % 9 == 0), "min_logprob": F.col("min_logprob") - 1})
    return gates.conversion_deltas(rows.where("problem_id % 89 <> 0"), after, split=_split("_key")).select(*fixed.DELTA_FIELDS)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')))) AS gram FROM w WHERE len(ws) >= 13),
  k AS (SELECT DISTINCT gram FROM g WHERE doc_id % 3 = 0),
  c AS (SELECT doc_id, count(*) AS n_grams, count(k.gram) AS n_shared FROM g LEFT JOIN k ON k.gram = g.gram WHERE doc_id % 3 <> 0 GROUP BY doc_id)
  SELECT * FROM c WHERE n_shared > 0 AND n_shared >= 0.2 * n_grams""")
def holdout_overlap(spark, sf_dir):
    docs = derive.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gates.overlaps(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND coalesce(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL), true)")
def holdout_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return gates.without_leaks(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "doc_id").select("doc_id")


@query(f"""WITH {duck.JOINED}, r AS (SELECT problem_id, category, answer_min_logprob, row_number() OVER (PARTITION BY category ORDER BY answer_min_logprob, problem_id) AS replay_rank FROM joined
    WHERE NOT is_correct AND answer_min_logprob < -3.0 AND problem_id % 10 <> 0),
  c AS (SELECT *, row_number() OVER (ORDER BY replay_rank, category, problem_id) AS place FROM r WHERE replay_rank <= 50) SELECT problem_id, category, answer_min_logprob, replay_rank FROM c WHERE place <= 200""")
def replay_rows(spark, sf_dir):
    rows = queries._joined(spark, sf_dir).where(~F.col("is_correct") & (F.col("answer_min_logprob") < fixed.BOOST_LOGPROB))
    held_out = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("problem_id"))
    return gates.replay_rows(rows.join(held_out, "problem_id", "left_anti").select("problem_id", "category", "answer_min_logprob"), size=200)


# the strata of the evaluation tiers: brittle, conversion-sensitive, failed, and the rest for coverage
@query(f"""WITH {_MODES}, s AS (SELECT problem_id, CASE WHEN coalesce(min_logprob < -2.0, false) THEN 'brittle' WHEN delta_label IN ('regression', 'improvement') THEN 'conversion_sensitive' WHEN NOT is_correct THEN 'failed' ELSE 'coverage' END AS stratum FROM modes),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || problem_id), problem_id) AS k FROM s),
  d AS (SELECT problem_id, stratum, CASE WHEN k <= CASE stratum WHEN 'coverage' THEN 35 WHEN 'failed' THEN 20 WHEN 'conversion_sensitive' THEN 20 ELSE 25 END THEN 'quota' ELSE 'backfill' END AS drawn FROM r),
  o AS (SELECT *, row_number() OVER (ORDER BY drawn DESC, problem_id) AS place FROM d) SELECT problem_id, stratum, drawn FROM o WHERE place <= 100""")
def quick_gate(spark, sf_dir):
    sensitive, brittle = F.col("delta_label").isin("regression", "improvement"), F.coalesce(F.col("min_logprob") < fixed.LOW_LOGPROB, F.lit(False))
    stratum = F.when(brittle, "brittle").when(sensitive, "conversion_sensitive").when(~F.col("is_correct"), "failed").otherwise("coverage")
    rows = _modes(spark, sf_dir).select("problem_id", stratum.alias("stratum"))
    return sampling.tiered(rows, "quick", ["coverage", "failed", "conversion_sensitive", "brittle"], key="problem_id", category="stratum")


@query(f"WITH {duck.PREDICTIONS}, source AS (SELECT problem_id AS key, 'of ' || category AS label, 'of ' || category || ' ' || raw_output || ' ' || question AS t FROM predictions), {duck.KEYWORDS} SELECT c.key AS problem_id, c.category, c.subcategory, c.confidence, c.manual_review_required, left(p.question, 300) AS question, p.gold_answer FROM classified c JOIN predictions p ON p.problem_id = c.key")
def labelled_set(spark, sf_dir):
    rows = classify.by_keywords(derive.predictions(spark, sf_dir).withColumnRenamed("category", "label").drop("subcategory"), category=F.concat(F.lit("of "), "label"), question=F.col("raw_output"), examples=F.col("question"))
    return classify.labelled_set(rows)


@query(f"WITH {duck.JOINED}, a AS (SELECT category, avg(min_logprob) AS avg_min_logprob, min(problem_id) AS first FROM joined WHERE min_logprob IS NOT NULL GROUP BY category) SELECT category, avg_min_logprob FROM a ORDER BY avg_min_logprob, first LIMIT 1")
def least_confident_category(spark, sf_dir):
    rows = queries._joined(spark, sf_dir).where("min_logprob is not null")
    grouped = rows.groupBy("category").agg(F.avg("min_logprob").alias("avg_min_logprob"), F.min("problem_id").alias("first"))
    return aggregate.worst(grouped, "avg_min_logprob", "category", "first")


@query(f"WITH {duck.STATS} SELECT problem_id, min_logprob, mean_logprob, answer_min_logprob FROM stats")
def logprob_structs(spark, sf_dir):
    rows = derive.tokens(spark, sf_dir)
    paired = rows.withColumn("token_logprobs", F.arrays_zip(F.col("tokens").alias("token"), F.col("token_logprobs").alias("logprob")))
    return logprob.stats(paired).select("problem_id", "min_logprob", "mean_logprob", "answer_min_logprob")


@query(f"WITH {duck.ALL_CASES}, o AS (SELECT problem_id, category, failure_type, example_priority, row_number() OVER (ORDER BY example_priority DESC, failure_type, problem_id) AS rank FROM all_cases) SELECT * FROM o WHERE rank <= 100")
def cases_in_order(spark, sf_dir):
    rows = queries._all_cases(spark, sf_dir).select("problem_id", "category", "failure_type", "example_priority")
    return aggregate.top(failures.in_order(rows, "problem_id"), 100, F.desc("example_priority"), "failure_type", "problem_id")


@query(f"""WITH {duck.COT}, g AS (SELECT problem_id, solver_answer AS answer, row_number() OVER (ORDER BY problem_id) AS k FROM cot WHERE verified AND category IN ('cryptarithm_deduce', 'cryptarithm_guess') AND solver_answer <> '') SELECT problem_id, answer FROM g WHERE k <= 25""")
def patch_first(spark, sf_dir):
    rows, _ = patch.build(queries._samples(spark, sf_dir), order="problem_id", max_rows=25)
    return rows.select("problem_id", "answer")


@query("""SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || '|' || '@' || '|' || upper(split_part(p_name, ' ', 2)) || '|' || 'OUT' || p_partkey AS parsed FROM part WHERE p_partkey % 5 < 3
  UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 >= 3""")
def examples_of_any_form(spark, sf_dir):
    """Examples nested in objects under other names, as pairs in lists, as text with an arrow; none where there are none."""
    k = F.col("p_partkey")
    expression = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("@"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))))
    out = F.concat(F.lit("OUT"), k.cast("string"))
    nested = F.concat(F.lit('{"train": [{"x": "'), expression, F.lit('", "y": "'), out, F.lit('"}]}'))
    listed = F.concat(F.lit('[["'), expression, F.lit('", "'), out, F.lit('"]]'))
    arrow = F.concat(expression, F.lit(" -> "), out)
    raw = F.when(k % 5 == 0, nested).when(k % 5 == 1, listed).when(k % 5 == 2, arrow).when(k % 5 == 3, "").otherwise("{}")
    rows = solver.examples_from_any(table(spark, sf_dir, "part").select(k, raw.alias("examples")), "examples")
    first = F.get("parsed", F.lit(0))
    return rows.select("p_partkey", F.when(F.size("parsed") > 0, F.concat_ws("|", first["left"], first["op"], first["right"], first["output"])).alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN user_id % 3 = 0 THEN 'eos' WHEN user_id % 512 >= 256 THEN 'length' ELSE 'unknown' END AS finish_reason FROM events")
def finish_reason_of(spark, sf_dir):
    tokens = F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 512)
    return table(spark, sf_dir, "events").select("event_id", text.finish_reason(tokens, F.col("user_id") % 3 == 0, F.lit(256)).alias("finish_reason"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": [1, {"y": "é", "z": ' || event_id || '}], "b": ' || user_id || '}' WHEN 1 THEN 'no json {' || event_id WHEN 2 THEN '' ELSE '[1, 2.5, null, true]' END AS canonical FROM events""")
def canonical_examples(spark, sf_dir):
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = derive.pick(F.col("event_id") % 4, ["", "", "", "[1,2.5,  null,true]"])
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"b":'), u, F.lit(',"a":[1,{"z":'), k, F.lit(',"y":"\\u00e9"}]}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("no json {"), k)).otherwise(raw)
    rows = derive.spread(table(spark, sf_dir, "events").select("event_id", "user_id"))
    return rows.select("event_id", text.canonical_json(raw).alias("canonical"))

"""The derived views and building blocks in DuckDB's SQL, for independent checks of the queries."""

from __future__ import annotations

from ..functions import fixed
from .derive import CATEGORIES, OPENINGS, SUBCATEGORIES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def transform(name: str, a: str, b: str) -> str:
    turn = lambda x, y: f"array_to_string(list_transform(range(1, greatest(length({x}), length({y})) + 1), lambda i: substr({x}, i, 1) || substr({y}, i, 1)), '')"
    return {
        "forward_concat": f"({a} || {b})", "reverse_concat": f"({b} || {a})", "reverse_left": f"(reverse({a}) || {b})", "reverse_right": f"({a} || reverse({b}))",
        "reverse_both": f"(reverse({a}) || reverse({b}))", "interleave_lr": turn(a, b), "interleave_rl": turn(b, a),
    }[name]


RULES = ["forward_concat", "reverse_concat", "reverse_left", "reverse_right", "reverse_both", "interleave_lr", "interleave_rl"]


def by_number(number: str, a: str, b: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} = {i} THEN {transform(r, a, b)}" for i, r in enumerate(RULES)) + " END"


def by_name(name: str, a: str, b: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{r}' THEN {transform(r, a, b)}" for r in RULES) + f" ELSE {a} || {b} END"


def clean(text: str) -> str:
    t = f"trim(coalesce({text}, ''))"
    return (
        f"regexp_replace(CASE WHEN regexp_matches({t}, {q(fixed.BOXED)}) THEN regexp_extract({t}, {q(fixed.BOXED)}, 1) WHEN regexp_matches({t}, {q(fixed.STATED)}, 'i') THEN regexp_extract({t}, {q(fixed.STATED)}, 1, 'i') "
        f"WHEN regexp_matches({t}, {q(fixed.QUOTED)}) THEN regexp_extract({t}, {q(fixed.QUOTED)}, 1) ELSE {t} END, '[^A-Za-z0-9]', '', 'g')"
    )


def _subcategory() -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {listed(s)}[((k // 5) % 4 + 1)::INT]" for c, s in SUBCATEGORIES.items()) + " ELSE 'n/a' END"


PREDICTIONS = f"""pred0 AS (
  SELECT *, o_orderkey AS k, {listed(CATEGORIES)}[(o_orderkey % 5 + 1)::INT] AS category, {listed(OPENINGS)}[((o_orderkey // 120) % 12 + 1)::INT] AS opening, (o_orderkey // 20) % 6 AS form, 'A' || o_orderkey AS gold FROM orders
), predictions AS (
  SELECT k AS problem_id, category, {_subcategory()} AS subcategory, 'Problem ' || k || ' of ' || category AS question, gold AS gold_answer,
    CASE form WHEN 0 THEN opening || 'So \\boxed{{' || gold || '}} done' WHEN 1 THEN opening || 'Try \\boxed{{X' || k || '}}' WHEN 2 THEN opening || 'The answer is ' || gold || '.'
      WHEN 3 THEN opening || 'Step one.' || chr(10) || 'Step two' || chr(10) || gold WHEN 4 THEN opening || 'Result \\boxed{{ }}' ELSE '' END AS raw_output,
    CASE o_orderstatus WHEN 'F' THEN 'eos' WHEN 'O' THEN 'length' ELSE 'unknown' END AS finish_reason, floor(o_totalprice % 2048)::BIGINT AS generation_token_count, o_orderstatus = 'O' AS was_truncated
  FROM pred0
)"""


def extraction(source: str, truncated: bool = False) -> str:
    """CTEs that end in ``extracted``: rows of ``source`` with pred_answer, reasoning_text and final_answer_text."""
    blocked = "AND NOT was_truncated" if truncated else ""
    return f"""x0 AS (
  SELECT *, regexp_matches(raw_output, {q(fixed.BOXED)}, 's') AS has_box, regexp_replace(regexp_extract(raw_output, {q(fixed.PHRASE)}, 1, 'i'), '[^A-Za-z0-9]', '', 'g') AS phrase,
    list_filter(list_transform(string_split(raw_output, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS lines,
    regexp_extract(raw_output, {q(fixed.BOXED)}, 0, 's') AS box, regexp_extract(raw_output, {q(fixed.PHRASE)}, 0, 'i') AS said FROM {source}
), x1 AS (
  SELECT *, len(lines) > 0 AND regexp_matches(lines[-1], {q(fixed.LAST_LINE)}) {blocked} AS use_last FROM x0
), extracted AS (
  SELECT * EXCLUDE (has_box, phrase, lines, box, said, use_last),
    CASE WHEN has_box THEN trim(regexp_extract(raw_output, {q(fixed.BOXED)}, 1, 's')) WHEN phrase <> '' THEN phrase WHEN use_last THEN trim(regexp_extract(lines[-1], {q(fixed.LAST_LINE)}, 0)) END AS pred_answer,
    CASE WHEN has_box THEN trim(substr(raw_output, 1, strpos(raw_output, box) - 1)) WHEN phrase <> '' THEN trim(substr(raw_output, 1, strpos(raw_output, said) - 1), ' ' || chr(10)) WHEN use_last THEN array_to_string(lines[1:-2], chr(10)) ELSE trim(raw_output) END AS reasoning_text,
    CASE WHEN has_box THEN box WHEN phrase <> '' THEN said WHEN use_last THEN lines[-1] END AS final_answer_text
  FROM x1
)"""


SCORED = f"""{PREDICTIONS}, {extraction('predictions')}, scored AS (
  SELECT *, coalesce(pred_answer, '') <> '' AND upper(regexp_replace(pred_answer, '\\s+', '', 'g')) = upper(regexp_replace(gold_answer, '\\s+', '', 'g')) AS is_correct, pred_answer IS NOT NULL AS parse_success,
    CASE WHEN pred_answer IS NOT NULL THEN NULL WHEN length(trim(raw_output)) < 10 THEN 'empty_output' ELSE 'no_extractable_answer' END AS parse_error_type
  FROM extracted
)"""

TOKENS = """tokens0 AS (
  SELECT l_orderkey AS problem_id, list(-(l_quantity / 10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS token_logprobs,
    list(CASE WHEN l_linenumber % 3 = 0 THEN 'the answer is' ELSE l_returnflag || l_linestatus || ' ' END ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) AS tokens
  FROM lineitem GROUP BY l_orderkey
)"""

#: Token statistics; the answer starts at the first token whose text is a marker.
STATS = f"""{TOKENS}, stats0 AS (
  SELECT *, list_min(token_logprobs) AS low, list_position(tokens, 'the answer is') AS start FROM tokens0
), stats1 AS (
  SELECT *, list_position(token_logprobs, low) AS pos, CASE WHEN start > 0 THEN list_slice(token_logprobs, start, len(token_logprobs)) END AS answer FROM stats0
), stats AS (
  SELECT problem_id, round_even(low, 4) AS min_logprob, round_even(list_sum(token_logprobs) / len(token_logprobs), 4) AS mean_logprob, round_even(list_min(answer), 4) AS answer_min_logprob, round_even(list_sum(answer) / len(answer), 4) AS answer_mean_logprob,
    len(list_filter(token_logprobs, lambda x: x < {fixed.LOW_LOGPROB}))::BIGINT AS low_conf_token_count, tokens[pos] AS lowest_logprob_token, array_to_string(tokens[greatest(1, pos - 5):pos + 5], '') AS lowest_logprob_context,
    coalesce(len(list_filter(answer, lambda x: x < {fixed.LOW_LOGPROB})), 0)::BIGINT AS answer_low_conf_token_count, array_to_string(tokens[greatest(1, pos - 5):pos - 1], '') AS left_context, array_to_string(tokens[pos + 1:pos + 5], '') AS right_context,
    CASE WHEN start > 0 THEN start - 1 END AS answer_start
  FROM stats1
)"""


def _example(i: int) -> str:
    a, b = f"('P{i}' || substr(l, 1, 2))", f"('Q{i}' || substr(r, 1, 3))"
    if i == 1:
        return f"{{'input': {a} || op || {b}, 'output': CASE WHEN k % 7 = 0 THEN 'ZZ1' ELSE {by_number('rule', a, b)} END}}"
    return f"{{'input': {a} || CASE WHEN k % 5 <> 0 THEN op WHEN op = '@' THEN '#' ELSE '@' END || {b}, 'output': CASE WHEN k % 7 = 0 THEN 'ZZ{i}' WHEN k % 5 = 0 THEN {by_number('(rule + 1) % 7', a, b)} ELSE {by_number('rule', a, b)} END}}"


PROBLEMS = f"""prob0 AS (
  SELECT p_partkey AS k, upper(split_part(p_name, ' ', 1)) AS l, upper(split_part(p_name, ' ', 2)) AS r, ['@', '#', '?', '+'][(p_partkey % 4 + 1)::INT] AS op, p_size % 7 AS rule FROM part
), problems AS (
  SELECT k AS problem_id, CASE WHEN k % 11 = 0 THEN 'arithmetic' WHEN k % 3 = 0 THEN 'cryptarithm_guess' ELSE 'cryptarithm_deduce' END AS category,
    CASE WHEN k % 17 = 0 THEN 'no operator here' ELSE l || op || r END AS question,
    CASE WHEN k % 19 = 0 THEN '' WHEN k % 3 = 1 THEN 'answer: ' || {by_number('rule', 'l', 'r')} || '.' ELSE {by_number('rule', 'l', 'r')} END AS answer,
    CASE WHEN k % 13 = 0 THEN [] WHEN k % 2 = 1 THEN [{_example(1)}, {_example(2)}, {_example(3)}] ELSE [{_example(1)}, {_example(2)}] END AS examples
  FROM prob0
)"""

_EXPR = q(fixed.EXPRESSION)
_PARSED = f"list_transform(examples, lambda e: {{'left': regexp_extract(e.input, {_EXPR}, 1), 'op': regexp_extract(e.input, {_EXPR}, 2), 'right': regexp_extract(e.input, {_EXPR}, 3), 'output': {clean('e.output')}}})"
_COUNTS = lambda column: "[" + ", ".join(f"len(list_filter({column}, lambda e: {transform(r, 'e.left', 'e.right')} = e.output))" for r in RULES) + "]"

SOLVED = f"""{PROBLEMS}, sol0 AS (
  SELECT *, {_PARSED} AS ex, regexp_extract(question, {_EXPR}, 1) AS ql, regexp_extract(question, {_EXPR}, 2) AS qo, regexp_extract(question, {_EXPR}, 3) AS qr, regexp_matches(question, {_EXPR}) AS parsed, {clean('answer')} AS normalized_answer FROM problems
), sol1 AS (
  SELECT *, list_filter(ex, lambda e: e.op = qo) AS own FROM sol0
), sol2 AS (
  SELECT *, {_COUNTS('ex')} AS counts, {_COUNTS('own')} AS own_counts, {listed(RULES)} AS names FROM sol1
), sol3 AS (
  SELECT *, CASE WHEN len(ex) > 0 THEN names[list_position(counts, len(ex))] END AS whole, CASE WHEN len(own) > 0 THEN names[list_position(own_counts, len(own))] END AS conditioned FROM sol2
), sol4 AS (
  SELECT *, CASE WHEN NOT parsed THEN '' ELSE coalesce(whole, 'operator_conditioned_rule:' || qo || ':' || conditioned, '') END AS rule_type,
    (CASE WHEN NOT parsed OR len(ex) = 0 THEN 0 WHEN whole IS NOT NULL THEN len(ex) WHEN conditioned IS NOT NULL THEN len(own) ELSE list_max(counts) END)::BIGINT AS matched_examples, len(ex)::BIGINT AS total_examples,
    CASE WHEN NOT parsed THEN 'could not parse question expression' WHEN len(ex) = 0 THEN 'no examples; refusing fallback verification' WHEN whole IS NOT NULL THEN 'rule matches all ' || len(ex) || ' examples'
      WHEN conditioned IS NOT NULL THEN 'operator-conditioned rule matches ' || len(own) || ' examples with op ' || qo ELSE 'no rule matched all examples; best=' || names[list_position(counts, list_max(counts))] || ' matched ' || list_max(counts) || '/' || len(ex) END AS solver_notes
  FROM sol3
), sol5 AS (
  SELECT *, CASE WHEN rule_type = '' THEN '' ELSE {by_name("split_part(rule_type, ':', -1)", 'ql', 'qr')} END AS solver_answer FROM sol4
), sol6 AS (
  SELECT *, rule_type <> '' AND normalized_answer <> '' AND solver_answer = normalized_answer AS verified FROM sol5
), solved AS (
  SELECT *, CASE WHEN NOT parsed THEN 'extraction failure' WHEN rule_type = '' AND len(ex) = 0 THEN 'guess failure' WHEN rule_type = '' THEN 'wrong operator rule' WHEN verified THEN '' WHEN normalized_answer = '' THEN 'answer format failure' ELSE 'answer mismatch' END AS failure_type,
    CASE WHEN NOT parsed THEN 'none' WHEN rule_type = '' THEN 'low' WHEN verified AND matched_examples = total_examples THEN 'high' WHEN solver_answer <> '' THEN 'medium' ELSE 'low' END AS confidence
  FROM sol6
)"""

COT = f"""{SOLVED}, cot AS (
  SELECT *, CASE WHEN category = 'cryptarithm_guess' THEN 'We need to guess the hidden operation.' || chr(10) || 'Candidate rules: forward concatenation, reverse concatenation, swapped operands, reversed sides, and interleaving.' || chr(10) || 'Check each candidate against the examples:' ELSE 'We need to infer the rule from the examples.' END
    || chr(10) || array_to_string(list_transform(ex, lambda e, i: 'Example ' || i || ': input = ' || e.left || e.op || e.right || ', output = ' || e.output || '.') || ['The consistent solver-verified rule is: ' || rule_type || '.', 'Apply the rule to the question: ' || question || '.',
      'The solver obtains ' || solver_answer || ', matching the labeled answer.', 'Therefore, the answer is \\boxed{{' || solver_answer || '}}.'], chr(10)) AS reasoning_text
  FROM solved
)"""


def first_hit(text: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p)}, 'i') THEN {q(name)}" for name, p in rules) + f" ELSE {default} END"


def any_part(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


#: RE2 takes non-ASCII letters for no part of a word; these stand in for the ones that texts hold.
ASCII_TEXT = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'q', 'g')"


def look_around_free(pattern: str) -> str:
    return pattern.replace(r"(?<![a-z])&(?![a-z])", r"(^|[^A-Za-z])&([^A-Za-z]|$)").replace(r"(?<![a-z])\|(?![a-z])", r"(^|[^A-Za-z])\|([^A-Za-z]|$)")


KEYWORDS = f"""c0 AS (
  SELECT *, [{', '.join("{'category': " + q(c) + ", 'pattern': CASE " + ' '.join(f'WHEN regexp_matches(t, {q(p)}, ' + "'i')" + f' THEN {q(p)}' for p in ps) + ' END}' for c, ps in fixed.CATEGORY_PATTERNS.items())}] AS every FROM source
), c1 AS (
  SELECT *, list_filter(every, lambda x: x.pattern IS NOT NULL) AS hits, label IN ('cryptarithm_deduce', 'cryptarithm_guess') AS explicit FROM c0
), c2 AS (
  SELECT *, CASE WHEN explicit THEN 'cryptarithm' WHEN len(hits) = 0 THEN 'other' ELSE hits[1].category END AS category FROM c1
), classified AS (
  SELECT key, category, CASE category {' '.join(f"WHEN '{c}' THEN " + first_hit('t', [(s, look_around_free(p)) for s, p in rules], "'unknown'") for c, rules in fixed.SUBCATEGORY_PATTERNS.items())} WHEN 'other' THEN 'unknown' ELSE 'n/a' END AS subcategory,
    CASE WHEN explicit THEN 'high' WHEN len(hits) IN (1, 2) THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN explicit THEN 'explicit_category_field' WHEN len(hits) = 0 THEN 'no_match_fallback' WHEN len(hits) = 1 THEN 'single_keyword_match' ELSE 'multi_keyword_priority' END AS rule,
    CASE WHEN explicit THEN label ELSE array_to_string(list_transform(hits, lambda x: x.pattern), '|') END AS matched_keywords, NOT explicit AND (len(hits) = 0 OR len(hits) >= 3) AS manual_review_required
  FROM c2
)"""

SINGLE = lambda text: first_hit(text, fixed.SINGLE_PATTERNS, "'other'")

JOINED = f"{SCORED}, {STATS}, joined AS (SELECT s.*, t.* EXCLUDE (problem_id) FROM scored s LEFT JOIN stats t ON s.problem_id = t.problem_id)"

_GROUPS = f"""groups AS (
  SELECT category, subcategory, count(*) AS n, count(*) FILTER (is_correct) AS correct, avg(coalesce(min_logprob, answer_min_logprob)) AS m, avg(answer_min_logprob) AS a, count(*) FILTER (is_correct)::DOUBLE / count(*) AS acc,
    count(*) FILTER (NOT is_correct AND coalesce(coalesce(min_logprob, answer_min_logprob) < {fixed.LOW_LOGPROB}, false)) AS n_wrong_low_conf, count(*) FILTER (NOT is_correct AND NOT coalesce(coalesce(min_logprob, answer_min_logprob) < {fixed.LOW_LOGPROB}, false)) AS n_wrong_high_conf,
    count(*) FILTER (is_correct AND coalesce(coalesce(min_logprob, answer_min_logprob) < {fixed.LOW_LOGPROB}, false)) AS n_correct_low_conf
  FROM joined GROUP BY category, subcategory
), flagged AS (
  SELECT *, n > correct AND n_wrong_low_conf::DOUBLE / (n - correct) >= 0.5 AS low, category IN ('cryptarithm', 'bit_manipulation', 'numeral_conversion', 'arithmetic', 'equation') AS solvable FROM groups
), prioritised AS (
  SELECT category, subcategory, n, correct, round_even(acc, 4) AS accuracy, round_even(m, 4) AS avg_min_logprob, round_even(a, 4) AS avg_answer_min_logprob, n_wrong_low_conf, n_wrong_high_conf, n_correct_low_conf,
    greatest(1, least(5, CASE WHEN n >= 100 THEN 2 WHEN n >= 30 THEN 1 ELSE 0 END + CASE WHEN acc < 0.70 THEN 2 WHEN acc < 0.85 THEN 1 ELSE 0 END + low::INT + solvable::INT)) AS priority_score,
    coalesce(nullif(concat_ws('+', CASE WHEN n >= 100 THEN 'high_volume' WHEN n >= 30 THEN 'moderate_volume' END, CASE WHEN acc < 0.70 THEN 'low_accuracy' WHEN acc < 0.85 THEN 'moderate_accuracy_gap' END, CASE WHEN low THEN 'wrong_low_conf_concentrated' END, CASE WHEN solvable THEN 'solver_verifiable' END), ''), 'no_clear_priority_signal') AS priority_reason
  FROM flagged
)"""
PRIORITISED = f"{JOINED}, {_GROUPS}"


def _cases(rows: list[tuple[str, str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {{'failure_type': {t}, 'failure_reason': {q(r)}}}" for c, t, r in rows) + " END"


_SAID, _BOX = "contains(lower(raw_output), lower(gold_answer))", "regexp_matches(raw_output, '\\\\boxed\\{')"
_SAME = "(coalesce(pred_answer, '') <> '' AND upper(pred_answer) = upper(gold_answer))"
_RE = lambda p, flags="'i'": f"regexp_matches(raw_output, {q(p)}{', ' + flags if flags else ''})"
_HITS = lambda p: f"len(regexp_extract_all(raw_output, {q('(?i)' + p)}))"
_LETTERS, _DIGITS = "regexp_extract_all(raw_output, '([A-Z])\\s*=\\s*(\\d)', 1)", "regexp_extract_all(raw_output, '([A-Z])\\s*=\\s*(\\d)', 2)"
_PAIRS = f"len(list_distinct(list_transform({_LETTERS}, lambda x, i: x || {_DIGITS}[i])))"
_UNKNOWN = ("true", "'unknown'", "could not determine failure type from output")
_FORMAT = [("is_correct", *_UNKNOWN[1:]), (f"{_SAID} AND NOT {_BOX}", "'answer_format_error'", "correct value in output but missing \\boxed{} format"), (f"{_SAID} AND coalesce(pred_answer, '') = ''", "'final_parse_error'", "gold answer in reasoning but extraction failed")]
_HEX = lambda c: f"list_sort(string_split(regexp_replace(upper({c}), '[^0-9a-fA-F]', '', 'g'), ''))"

CASCADES = {
    "cryptarithm": _cases([
        ("is_correct", "'fragile_correct'", "correct but low logprob — protect from SFT"), (f"NOT {_SAME} AND {_SAID}", "'final_parse_error'", "gold answer appears in reasoning but extraction failed"),
        (f"{_PAIRS} > len(list_distinct({_LETTERS})) OR {_PAIRS} > len(list_distinct({_DIGITS}))", "'mapping_conflict'", "model assigns same digit to different letters or vice versa"),
        ("regexp_extract(raw_output, '([A-Z])\\s*=\\s*0', 1) <> '' AND regexp_matches(raw_output, '\\b' || regexp_extract(raw_output, '([A-Z])\\s*=\\s*0', 1) || '[A-Z]+\\s*[=+\\-]')", "'leading_zero_error'", "model violates no-leading-zero constraint"),
        (f"{_RE('the rule is.*(?:reverse|flip|negate)')} OR {_RE('applying.*pattern.*(?:not.*example|differ)')} OR {_RE('I will assume the rule')}", "'hallucinated_rule'", "model applies transformation rule not derivable from examples"),
        (f"{_RE(r'carry\s*=\s*\d.*carry\s*=\s*\d')} OR {_RE(r'carry\s+over')} OR {_RE(r'column\s+sum.*>.*10')}", "'carry_error'", "carry propagation mentioned but answer is wrong"),
        (f"({_HITS('let me try')} + {_HITS(r'assume\s+[A-Z]\s*=')} + {_HITS(r'checking.*[A-Z]\s*=\s*\d')}) BETWEEN 1 AND 2", "'incomplete_search'", "model makes only 1-2 assignment attempts on exhaustive search"),
        (f"{_RE(r'\d+\s*\+\s*\d+\s*=\s*\d+', '')} OR {_RE(r'\d+\s*\*\s*\d+\s*=\s*\d+', '')}", "'arithmetic_error'", "arithmetic expression present; may contain arithmetic mistake"), _UNKNOWN,
    ]),
    "bit_manipulation": _cases([
        *_FORMAT, (f"subcategory = 'xor' AND {_RE(r'\bAND\b|\bOR\b', '')} AND NOT {_RE(r'\bXOR\b', '')}", "'xor_error'", "model substituted AND/OR for XOR"), ("subcategory = 'xor'", "'xor_error'", "XOR result is incorrect"),
        (f"subcategory = 'and' AND {_RE(r'\bXOR\b', '')}", "'and_error'", "model applied XOR instead of AND"), ("subcategory = 'and'", "'and_error'", "AND bit result is incorrect"), (f"subcategory = 'shift_left' AND {_RE('shift')}", "'shift_error'", "shift direction or amount is wrong"),
        ("subcategory = 'shift_left'", "'shift_error'", "shift operation result is incorrect"), ("subcategory = 'mask'", "'mask_error'", "mask application result is incorrect"), (_RE("0b[01]+|binary"), "'base_conversion_error'", "binary representation error in sub-step"), _UNKNOWN,
    ]),
    "numeral_conversion": _cases([
        *_FORMAT, (f"coalesce(pred_answer, '') <> '' AND gold_answer <> '' AND {_HEX('pred_answer')} = {_HEX('gold_answer')}", "'digit_order_error'", "correct digits but wrong order"),
        ("subcategory = 'binary_to_decimal'", "'binary_decimal_error'", "binary-to-decimal place value calculation error"), ("subcategory = 'decimal_to_hex'", "'decimal_hex_error'", "decimal-to-hex conversion error"), ("subcategory = 'roman_numeral'", "'roman_numeral_error'", "Roman numeral rule application error"),
        (_RE("0b[01]+", ""), "'binary_decimal_error'", "binary representation detected — conversion error"), (_RE("0x[0-9a-fA-F]+", ""), "'hex_decimal_error'", "hex representation detected — conversion error"), _UNKNOWN,
    ]),
}


def _in(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def cases(category: str) -> str:
    """CTEs that end in ``<category>_cases``."""
    crypt = category == "cryptarithm"
    templates, default = {"cryptarithm": (fixed.CRYPTARITHM_TEMPLATES, fixed.CRYPTARITHM_DEFAULT_TEMPLATE), "bit_manipulation": (fixed.BIT_TEMPLATES, fixed.BIT_DEFAULT_TEMPLATE), "numeral_conversion": (fixed.NUMERAL_TEMPLATES, fixed.NUMERAL_DEFAULT_TEMPLATE)}[category]
    wanted = f"NOT is_correct OR coalesce(answer_min_logprob < {fixed.LOW_LOGPROB}, false)" if crypt else "NOT is_correct"
    solver = {"cryptarithm": "subcategory IN ('alphametic_addition', 'alphametic_subtraction', 'alphametic_multiplication', 'string_transform', 'unknown')", "bit_manipulation": "subcategory IN ('xor', 'and', 'or', 'shift_left', 'shift_right', 'binary_arithmetic')", "numeral_conversion": "true"}[category]
    synthetic = "failure_type IN ('mapping_conflict', 'carry_error', 'leading_zero_error', 'incomplete_search', 'answer_format_error')" if crypt else "failure_type <> 'unknown'"
    if crypt:
        base = "CASE WHEN failure_type IN ('mapping_conflict', 'carry_error', 'leading_zero_error') THEN CASE WHEN sol THEN 5 ELSE 4 END WHEN failure_type = 'incomplete_search' THEN CASE WHEN syn THEN 4 ELSE 3 END WHEN failure_type = 'final_parse_error' THEN 4 WHEN failure_type = 'answer_format_error' THEN 5 WHEN failure_type IN ('hallucinated_rule', 'fragile_correct') THEN 3 WHEN failure_type = 'arithmetic_error' THEN CASE WHEN sol THEN 3 ELSE 2 END ELSE 2 END"
    else:
        high = fixed.HIGH_VALUE_BIT if category == "bit_manipulation" else fixed.HIGH_VALUE_NUMERAL
        base = f"least(5, CASE WHEN failure_type IN {_in(high)} THEN CASE WHEN sol THEN 5 ELSE 4 END WHEN failure_type IN ('answer_format_error', 'final_parse_error', 'digit_order_error', 'mask_error') THEN 4 WHEN failure_type = 'unknown' THEN 2 ELSE 3 END + syn::INT)"
    p = category
    return f"""{p}_0 AS (SELECT *, {CASCADES[category]} AS f FROM joined WHERE category = '{category}' AND ({wanted})),
{p}_1 AS (SELECT *, f.failure_type AS failure_type, f.failure_reason AS failure_reason FROM {p}_0), {p}_2 AS (SELECT *, {solver} AS sol, {synthetic} AS syn FROM {p}_1),
{p}_cases AS (
  SELECT problem_id, category, subcategory, substr(question, 1, 300) AS question, gold_answer, pred_answer, is_correct, min_logprob, answer_min_logprob, failure_type, failure_reason, sol AS solver_check_possible, syn AS synthetic_generation_possible,
    CASE failure_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in templates.items())} ELSE '{default}' END AS recommended_template, CASE WHEN coalesce(answer_min_logprob < {fixed.BOOST_LOGPROB}, false) THEN least(5, {base} + 1) ELSE {base} END AS example_priority
  FROM {p}_2
)"""


ALL_CASES = f"{JOINED}, {cases('cryptarithm')}, {cases('bit_manipulation')}, {cases('numeral_conversion')}, all_cases AS (SELECT * FROM cryptarithm_cases UNION ALL SELECT * FROM bit_manipulation_cases UNION ALL SELECT * FROM numeral_conversion_cases)"

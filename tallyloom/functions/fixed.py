"""Patterns, labels, weights and column names that results must agree on."""

# Category patterns in order of priority, searched without regard to case.
CATEGORY_PATTERNS: dict[str, list[str]] = {
    "bit_manipulation": [r"\bXOR\b", r"\bAND\b", r"\bOR\b", r"\bNOT\b", r"\bshift\b", "<<", ">>", r"\b0b[01]+\b", r"\bbitwise\b", r"\bbinary\b.*\boperation\b", r"\bbit\b"],
    "numeral_conversion": [r"\bbinary\b", r"\bdecimal\b", r"\bhexadecimal\b", r"\bhex\b", r"\boctal\b", r"\bbase[ -]\d+\b", r"\broman numeral\b", r"\bconvert\b.*\bbase\b", r"\b0x[0-9a-fA-F]+\b", r"\b0b[01]+\b", r"\bconvert\b.*\bnumber\b"],
    "cipher": [r"\bcipher\b", r"\bencode\b", r"\bdecode\b", r"\bencrypt\b", r"\bdecrypt\b", r"\bcaesar\b", r"\bROT\d+\b", r"\bshift cipher\b"],
    "equation": [r"\bsolve\b.*\bfor\b", r"\bfind\b.*\bx\b", r"\bequation\b", r"\balgebra\b", r"\bvariable\b"],
    "unit_conversion": [r"\bkilometer\b", r"\bmiles?\b", r"\bkilogram\b", r"\bpounds?\b", r"\bcelsius\b", r"\bfahrenheit\b", r"\bliter\b", r"\bgallon\b", r"\bmeter\b", r"\bfeet\b", r"\binch\b", r"\bcm\b", r"\bmph\b", r"\bkph\b"],
    "rule_induction": [r"\bpattern\b", r"\bsequence\b", r"\binfer.*rule\b", r"\bnext.*element\b"],
    "logic": [r"\bimplies\b", r"\bif.*then\b", r"\bpropositional\b", r"\btruth table\b", r"\bboolean\b", r"\bde morgan\b"],
    "arithmetic": [r"\d+\s*[\+\-\*\/]\s*\d+", r"\bcalculate\b", r"\bcompute\b", r"\bsum\b", r"\bproduct\b", r"\bdifference\b"],
}

# Explicit category labels of letter-arithmetic problems.
CRYPTARITHM_LABELS = ("cryptarithm_deduce", "cryptarithm_guess")

# Subcategory patterns in order, searched without regard to case.
SUBCATEGORY_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "cryptarithm": [
        ("alphametic_addition", r"[\+]|plus"),
        ("alphametic_subtraction", r"[\-]|minus"),
        ("alphametic_multiplication", r"[\*×]|times|mul"),
        ("digit_assignment", r"\bassign\b|\bdigit\b"),
        ("carry_reasoning", r"\bcarry\b"),
        ("leading_zero_constraint", r"leading zero|no leading"),
        ("string_transform", r"[A-Z]{2,}\s*\?\s*[A-Z]{2,}"),
    ],
    "bit_manipulation": [
        ("xor", r"\bXOR\b|⊕"),
        ("and", r"\bAND\b|(?<![a-z])&(?![a-z])"),
        ("or", r"\bOR\b|(?<![a-z])\|(?![a-z])"),
        ("shift_left", r"<<|\bshl\b|\bshift left\b"),
        ("shift_right", r">>|\bshr\b|\bshift right\b"),
        ("mask", r"\bmask\b|\bbitmask\b"),
        ("signed_unsigned", r"\bsigned\b|\bunsigned\b|\btwo.?s complement\b"),
        ("binary_arithmetic", r"\bbinary addition\b|\bbinary subtraction\b"),
    ],
    "numeral_conversion": [
        ("binary_to_decimal", r"binary to decimal|0b[01]+ to \d|bin.*dec"),
        ("decimal_to_binary", r"decimal to binary|\d+ to binary|dec.*bin"),
        ("hex_to_decimal", r"hex(?:adecimal)? to decimal|0x[0-9a-fA-F]+ to \d"),
        ("decimal_to_hex", r"decimal to hex|\d+ to hex(?:adecimal)?"),
        ("roman_numeral", r"roman numeral|XLIV|MMXX"),
        ("base_n_conversion", r"base[ -]\d+|convert.*base"),
    ],
}

# One pattern for each category of the second classifier, in order.
SINGLE_PATTERNS: list[tuple[str, str]] = [
    ("cryptarithm", r"[A-Z]{2,}\s*\+\s*[A-Z]{2,}|each letter.*digit|letter.*unique|cryptarithm|cryptoarithm|send\s*\+\s*more|verbal arithmetic"),
    ("bit_manipulation", r"\bXOR\b|\bAND\b|\bOR\b|\bNOT\b|bitwise|bit.*shift|binary.*operat"),
    ("numeral_conversion", r"convert.*base|base\s*\d+|hexadecim|octal|binary.*number|number.*system|roman numeral|\bbase-\d"),
    ("cipher", r"caesar|vigenere|substitut.*cipher|encrypt|decrypt|cipher|encoded.*message|shift.*letter"),
    ("equation", r"solve.*equation|find.*value.*[xy]|system of equation|linear equation|quadratic"),
    ("arithmetic", r"sum of|product of|average|mean of|\bdivide\b|\bmultiply\b|remainder|modulo|\bmod\b|\bfactorial\b"),
]

# Sample quotas by category.
SAMPLE_QUOTAS = {"cryptarithm": 50, "bit_manipulation": 40, "numeral_conversion": 40, "cipher": 20, "equation": 20, "arithmetic": 15, "other": 15}

# Phrases and patterns of the third classifier.
LETTER_PHRASES = ["cryptarithm", "each letter represents", "each digit represents", "distinct digits", "unique digits", "no two letters", "different nonzero digits", "leading digit"]
LETTER_HINTS = ["unique", "digit", "represents"]
BIT_PHRASES = ["xor", "bit shift", "bitwise", "bit rotation", "bit manipulation", "majority", "choice function", "hamming", "parity bit", "8-bit", "binary string", "bits"]
NUMERAL_PHRASES = ["hexadecimal", "octal", "base-", "base 16", "base 8", "base 2", "convert to decimal", "convert to binary", "0x", "radix", "numeral system"]
WORD_SUM = r"\b[A-Z]{2,}\s*[+\-*]\s*[A-Z]{2,}"
BITS_ARROW = r"[01]{4,}\s*->"
BITS_TO_BITS = r"[01]{4,}\s*->\s*[01]{4,}"

# Patterns of answer extraction and of expressions.
BOXED = r"\\boxed\{([^{}]+)\}"
PHRASE = r"(?:the (?:final )?answer is|therefore|so the answer is|answer:)\s*(?:\\boxed\{)?([^\n\.\\{}]+)"
LAST_LINE = r"[A-Za-z0-9][A-Za-z0-9 _\-]*$"
MARKER = r"\\boxed\{|the answer is|therefore"
EXPRESSION = r"([A-Za-z0-9]+)\s*([^A-Za-z0-9\s]{1,4})\s*([A-Za-z0-9]+)"
EXAMPLE_TEXT = r"([A-Za-z0-9]+\s*[^A-Za-z0-9\s]{1,4}\s*[A-Za-z0-9]+)\s*(?:->|=>|=)\s*([A-Za-z0-9]+)"
STATED = r"(?:answer|therefore|so)\s*(?:is|=|:)\s*([A-Za-z0-9]+)\b"
QUOTED = r"""['"]([A-Za-z0-9]+)['"]\s*$"""

# Texts of the verified-data chain.
PATCH_SOURCE = "cryptarithm_solver_verified_cot"
MASK_POLICY = "final_answer_and_rule_application"

# Thresholds on log probabilities.
LOW_LOGPROB = -2.0
BOOST_LOGPROB = -3.0

# Categories that a solver can check.
SOLVER_VERIFIABLE = ("cryptarithm", "bit_manipulation", "numeral_conversion", "arithmetic", "equation")

# Recommended templates by failure type.
CRYPTARITHM_TEMPLATES = {
    "mapping_conflict": "exhaustive_backtracking_cot", "leading_zero_error": "constraint_checklist_cot", "carry_error": "column_by_column_carry_cot", "incomplete_search": "systematic_enumeration_cot",
    "arithmetic_error": "step_verify_cot", "constraint_missed": "constraint_first_cot", "final_parse_error": "boxed_answer_strict_cot", "hallucinated_rule": "example_grounded_rule_cot",
    "answer_format_error": "format_check_cot", "fragile_correct": "no_change_protect",
}
CRYPTARITHM_DEFAULT_TEMPLATE = "general_diagnostic_cot"
BIT_TEMPLATES = {
    "xor_error": "bitwise_xor_step_cot", "and_error": "bitwise_and_step_cot", "or_error": "bitwise_or_step_cot", "shift_error": "shift_direction_explicit_cot", "mask_error": "bitmask_application_cot",
    "signed_unsigned_error": "twos_complement_cot", "endian_error": "byte_order_explicit_cot", "base_conversion_error": "binary_to_decimal_substep_cot", "arithmetic_error": "step_verify_cot",
    "final_parse_error": "boxed_answer_strict_cot", "answer_format_error": "format_check_cot",
}
BIT_DEFAULT_TEMPLATE = "general_bit_diagnostic_cot"
NUMERAL_TEMPLATES = {
    "binary_decimal_error": "positional_binary_cot", "decimal_binary_error": "division_remainder_binary_cot", "hex_decimal_error": "hex_digit_table_cot", "decimal_hex_error": "division_remainder_hex_cot",
    "base_n_place_value_error": "positional_base_n_cot", "roman_numeral_error": "roman_rule_explicit_cot", "digit_order_error": "left_to_right_verify_cot", "final_parse_error": "boxed_answer_strict_cot", "answer_format_error": "format_check_cot",
}
NUMERAL_DEFAULT_TEMPLATE = "general_numeral_diagnostic_cot"

# Failure labels of numeral conversions by subcategory.
NUMERAL_LABELS = {
    "binary_to_decimal": "binary_decimal_error", "decimal_to_binary": "decimal_binary_error", "hex_to_decimal": "hex_decimal_error", "decimal_to_hex": "decimal_hex_error", "roman_numeral": "roman_numeral_error", "base_n_conversion": "base_n_place_value_error",
}

# Labels with a high example priority.
HIGH_VALUE_BIT = ("xor_error", "shift_error", "and_error", "or_error", "base_conversion_error", "signed_unsigned_error")
HIGH_VALUE_NUMERAL = ("binary_decimal_error", "decimal_binary_error", "hex_decimal_error", "decimal_hex_error", "base_n_place_value_error")

# Candidate column names by logical field, first found first.
ID_NAMES = ("problem_id", "id", "uid", "sample_id")
QUESTION_NAMES = ("question", "prompt", "input", "problem", "messages")
ANSWER_NAMES = ("answer", "target", "output", "solution", "label")
EXAMPLE_NAMES = ("examples", "shots", "demonstrations", "few_shot", "metadata")
CATEGORY_NAMES = ("category", "task", "problem_type", "type", "source_category")
CSV_ALIASES = {
    "question": ("question", "problem", "prompt", "input", "text"),
    "answer": ("answer", "solution", "target", "output", "label"),
    "problem_id": ("id", "problem_id", "uid", "sample_id", "index"),
}

# Subcategories that a solver can check, and kinds of failure that examples can be made for.
SOLVABLE_LETTERS = ["alphametic_addition", "alphametic_subtraction", "alphametic_multiplication", "string_transform", "unknown"]
SOLVABLE_BITS = ["xor", "and", "or", "shift_left", "shift_right", "binary_arithmetic"]
SYNTHETIC_LETTERS = ["mapping_conflict", "carry_error", "leading_zero_error", "incomplete_search", "answer_format_error"]

# Primary labels of the failure taxonomy.
FAILURE_LABELS = [
    "FORMAT_FAILURE", "EXTRACTION_FAILURE", "EASY_TASK_REGRESSION", "OPERATOR_CONFUSION", "BIT_RULE_FAILURE", "POSITIONAL_MISMATCH", "LOW_LOGPROB_COLLAPSE",
    "PREPOST_CONVERSION_REGRESSION", "OVERFITTING_TO_DIAGNOSTIC", "UNKNOWN",
]

# Fields of the category manifest, of measured samples, of fragile samples and of conversion deltas.
MANIFEST_FIELDS = ["sample_id", "split_name", "category", "difficulty_bucket", "failure_mode_primary", "failure_mode_secondary", "conversion_sensitive_flag", "inclusion_reason"]
MEASURED_FIELDS = ["sample_id", "split_name", "category", "baseline_prediction_status", "baseline_correctness", "format_failure_flag", "extraction_failure_flag", "runtime_status", "notes"]
FRAGILE_FIELDS = [
    "sample_id", "split_name", "category", "correctness", "min_logprob_value", "min_logprob_token", "local_context_left", "local_context_right", "failure_mode_primary",
    "failure_mode_secondary", "pre_or_post_conversion_label",
]
DELTA_FIELDS = [
    "sample_id", "split_name", "category", "baseline_pre_conversion_result", "baseline_post_conversion_result", "delta_label", "format_failure_pre", "format_failure_post",
    "min_logprob_pre", "min_logprob_post", "brittle_subset_flag",
]
# Fixed value: numbers of two answers agree within this.
METRIC_TOLERANCE = 1e-2

# What the failure classifiers look for.
LETTER_DIGIT = r"([A-Z])\s*=\s*(\d)"
LETTER_ZERO = r"([A-Z])\s*=\s*0"
ATTEMPTS = [r"let me try", r"assume\s+[A-Z]\s*=", r"checking.*[A-Z]\s*=\s*\d"]
INVENTED_RULES = [r"the rule is.*(?:reverse|flip|negate)", r"applying.*pattern.*(?:not.*example|differ)", r"I will assume the rule"]
CARRIES = [r"carry\s*=\s*\d.*carry\s*=\s*\d", r"carry\s+over", r"column\s+sum.*>.*10"]
CALCULATIONS = [r"\d+\s*\+\s*\d+\s*=\s*\d+", r"\d+\s*\*\s*\d+\s*=\s*\d+"]

# Reasons of failures.
REASONS = {
    "fragile": "correct but low logprob — protect from SFT",
    "said_letters": "gold answer appears in reasoning but extraction failed",
    "format_letters": "correct value in output but missing \\boxed{} or wrong format",
    "conflict": "model assigns same digit to different letters or vice versa",
    "leading_zero": "model violates no-leading-zero constraint",
    "invented": "model applies transformation rule not derivable from examples",
    "carry": "carry propagation mentioned but answer is wrong",
    "few_attempts": "model makes only 1-2 assignment attempts on exhaustive search",
    "arithmetic": "arithmetic expression present; may contain arithmetic mistake",
    "unknown": "could not determine failure type from output",
    "format": "correct value in output but missing \\boxed{} format",
    "said": "gold answer in reasoning but extraction failed",
    "not_xor": "model substituted AND/OR for XOR",
    "xor": "XOR result is incorrect",
    "shift_said": "shift direction or amount is wrong",
    "shift": "shift operation result is incorrect",
    "mask": "mask application result is incorrect",
    "sign_said": "signed/unsigned interpretation error",
    "sign": "signed vs unsigned confusion",
    "binary_arithmetic": "binary arithmetic calculation error",
    "base": "binary representation error in sub-step",
    "digit_order": "correct digits but wrong order",
    "binary_seen": "binary representation detected — conversion error",
    "hex_seen": "hex representation detected — conversion error",
    "wrong_operator": "model applied XOR instead of {}",
    "operator": "{} bit result is incorrect",
}
# In the order of the numeral labels.
NUMERAL_REASONS = [
    "binary-to-decimal place value calculation error", "decimal-to-binary encoding error", "hex digit value mapping error", "decimal-to-hex conversion error",
    "Roman numeral rule application error", "place value error in base-N conversion",
]

# What the notebook's failure classifier looks for, and its labels.
LETTERS_ASSIGNED = r"[A-Z]\s*[=:]\s*\d|\d\s*[=:]\s*[A-Z]"
BITS_SEEN = r"\b[01]{4,}\b"
BINARY_SEEN = r"0b[01]+"
HEX_SEEN = r"0x[0-9a-fA-F]+"
NOTEBOOK_LABELS = {
    "right": "correct", "unparsed": "parse_fail", "cut": "timeout", "letters": "wrong_digit_assignment", "boxed": "wrong_answer_boxed", "no_letters": "no_systematic_attempt",
    "bits": "wrong_binary_result", "no_bits": "no_binary_analysis", "number": "wrong_converted_value", "no_number": "no_conversion_attempt", "other": "wrong_answer",
}

# Notes, failures and confidence of the rule solver.
SOLVER_NOTES = {
    "no_question": "could not parse question expression",
    "no_examples": "no examples; refusing fallback verification",
    "all": "rule matches all %s examples",
    "operator": "operator-conditioned rule matches %s examples with op %s",
    "none": "no rule matched all examples; best=%s matched %s/%s",
}
SOLVER_FAILURES = {
    "no_question": "extraction failure", "no_examples": "guess failure", "no_rule": "wrong operator rule", "verified": "", "no_answer": "answer format failure", "mismatch": "answer mismatch",
}

# The verified solution as text.
GUESS_OPENING = "We need to guess the hidden operation.\nCandidate rules: forward concatenation, reverse concatenation, swapped operands, reversed sides, and interleaving.\nCheck each candidate against the examples:"
DEDUCE_OPENING = "We need to infer the rule from the examples."
EXAMPLE_LINE = "Example %s: input = %s%s%s, output = %s."
RULE_LINE = "The consistent solver-verified rule is: %s."
APPLY_LINE = "Apply the rule to the question: %s."
SOLVED_LINE = "The solver obtains %s, matching the labeled answer."
ANSWER_LINE = "Therefore, the answer is \\boxed{%s}."

# The prompt.
PROMPT = "Solve the following problem carefully.\n\n%sQuestion: %s\n\nThink step by step. Put your final answer inside \\boxed{}."
PROMPT_EXAMPLES = "Examples:\n%s\n\n"
PROMPT_EXAMPLE = "  %s. Input: %s -> Output: %s"

# What is said of samples and records that don't belong in a patch.
PATCH_ERRORS = {
    "category": "unexpected category %s", "unverified_sample": "sample.verified must be true", "question": "missing question", "solver_answer": "missing solver_answer",
    "reasoning_text": "missing reasoning_text", "answer": "missing answer", "messages": "expected two chat messages", "role": "message %s role must be '%s'",
    "content": "message %s missing content", "message": "message %s must be an object", "json": "invalid JSON", "object": "not an object", "metadata": "metadata must be an object", "unverified": "metadata.verified must be true", "no_rows": "patch contains no rows",
}

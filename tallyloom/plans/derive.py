"""Deterministic views over the driver's tables, so that every operator has rows that exercise it.

Each view is defined by integer arithmetic on keys; ``duck.py`` states the same in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import TRANSFORMS

CATEGORIES = ["cryptarithm", "bit_manipulation", "numeral_conversion", "cipher", "arithmetic"]
SUBCATEGORIES = {
    "cryptarithm": ["alphametic_addition", "digit_assignment", "string_transform", "unknown"],
    "bit_manipulation": ["xor", "and", "shift_left", "mask"],
    "numeral_conversion": ["binary_to_decimal", "decimal_to_hex", "roman_numeral", "unknown"],
}
OPENINGS = [
    "A = 1, A = 2. ", "B = 0. BCD + E = F. ", "carry = 1 then carry = 0. ", "Let me try. ", "The rule is to reverse. ", "12 + 7 = 19. ",
    "Use XOR here. ", "Use AND gate. ", "0b1011 is binary. ", "0x1F is hex. ", "Assume B = 3. ", "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores before costly expressions where the scan has fewer files than there are cores; others stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output by order: category, gold answer and one of six answer forms with one of twelve openings."""
    k = F.col("o_orderkey")
    div = lambda n: F.floor(k / n)
    category = pick(k % 5, CATEGORIES)
    sub = F.lit("n/a")
    for name, subs in SUBCATEGORIES.items():
        sub = F.when(category == name, pick(div(5) % 4, subs)).otherwise(sub)
    text = k.cast("string")
    gold = F.concat(F.lit("A"), text)
    opening = pick(div(120) % 12, OPENINGS)
    form = div(20) % 6
    raw = (
        F.when(form == 0, F.concat(opening, F.lit("So \\boxed{"), gold, F.lit("} done")))
        .when(form == 1, F.concat(opening, F.lit("Try \\boxed{X"), text, F.lit("}")))
        .when(form == 2, F.concat(opening, F.lit("The answer is "), gold, F.lit(".")))
        .when(form == 3, F.concat(opening, F.lit("Step one.\nStep two\n"), gold))
        .when(form == 4, F.concat(opening, F.lit("Result \\boxed{ }")))
        .otherwise("")
    )
    finish = F.when(F.col("o_orderstatus") == "F", "eos").when(F.col("o_orderstatus") == "O", "length").otherwise("unknown")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")).select(
        k.alias("problem_id"), category.alias("category"), sub.alias("subcategory"), F.concat(F.lit("Problem "), text, F.lit(" of "), category).alias("question"), gold.alias("gold_answer"), raw.alias("raw_output"),
        finish.alias("finish_reason"), F.floor(F.col("o_totalprice") % 2048).cast("long").alias("generation_token_count"), (finish == "length").alias("was_truncated"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the extracted answer, its match and parse errors."""
    from ..functions import text

    raw = F.col("raw_output")
    rows = predictions(spark, sf_dir).select("*", F.inline(F.array(text.extract_answer(raw))))  # once for each row: filters on answers stay behind
    pred = F.col("pred_answer")
    return rows.withColumns({"is_correct": text.answers_match(pred, F.col("gold_answer")), "parse_success": pred.isNotNull(), "parse_error_type": text.parse_error_type(pred, raw)})


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each order's lines, in an order without ties: (problem_id, token_logprobs, tokens)."""
    piece = F.when(F.col("l_linenumber") % 3 == 0, "the answer is").otherwise(F.concat("l_returnflag", "l_linestatus", F.lit(" ")))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", piece.alias("token"))
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("problem_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return grouped.select("problem_id", F.transform("lines", lambda x: -(x["l_quantity"] / 10)).alias("token_logprobs"), F.transform("lines", lambda x: x["token"]).alias("tokens"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transform problems by part: question, answer, examples as (input, output) structs, and source order."""
    k, size = F.col("p_partkey"), F.col("p_size")
    left, right = F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2)))
    names = list(TRANSFORMS)

    def by_number(number: Column, a: Column, b: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for i, name in enumerate(names):
            out = out.when(number == i, TRANSFORMS[name](a, b))
        return out

    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select(k, size, left.alias("l"), right.alias("r"))
    op, rule, mixed = pick(k % 4, ["@", "#", "?", "+"]), size % 7, (k % 5 == 0)

    def example(i: int) -> Column:
        a, b = F.concat(F.lit(f"P{i}"), F.substring("l", 1, 2)), F.concat(F.lit(f"Q{i}"), F.substring("r", 1, 3))
        own = F.when(mixed & F.lit(i > 1), F.when(op == "@", "#").otherwise("@")).otherwise(op)
        number = F.when(mixed & F.lit(i > 1), (rule + 1) % 7).otherwise(rule)
        output = F.when(k % 7 == 0, F.lit(f"ZZ{i}")).otherwise(by_number(number, a, b))
        return F.struct(F.concat(a, own, b).alias("input"), output.alias("output"))

    pairs = F.array(example(1), example(2))
    none = F.array().cast("array<struct<input:string,output:string>>")
    examples = F.when(k % 13 == 0, none).when(k % 2 == 1, F.array(example(1), example(2), example(3))).otherwise(pairs)
    question = F.when(k % 17 == 0, F.lit("no operator here")).otherwise(F.concat("l", op, "r"))
    answer = F.when(k % 19 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("answer: "), by_number(rule, F.col("l"), F.col("r")), F.lit("."))).otherwise(by_number(rule, F.col("l"), F.col("r")))
    category = F.when(k % 11 == 0, "arithmetic").when(k % 3 == 0, "cryptarithm_guess").otherwise("cryptarithm_deduce")
    return rows.select(k.alias("problem_id"), category.alias("category"), question.alias("question"), answer.alias("answer"), examples.alias("examples"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation by turn."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))

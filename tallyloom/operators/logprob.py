"""Statistics over the log probabilities of generated tokens, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.text import let

WINDOW = 100
CONTEXT = 5


def values(df: DataFrame, logprobs: str) -> Column:
    """Log probabilities of either encoding: numbers, or structs of token and logprob."""
    kind = df.schema[logprobs].dataType.elementType
    return F.transform(logprobs, lambda t: t["logprob"]) if isinstance(kind, T.StructType) else F.col(logprobs)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def low(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x < fixed.LOW_LOGPROB)).cast("long")


def answer_start(texts: Column) -> Column:
    """Number (from 0) of the first token at which the last 100 characters of the text so far hold a marker; null if none.

    A marker is complete where the last character of its first match ends up, so the first token whose
    running text holds the first match is looked up by prefix sums of token lengths.
    """
    pattern = "(?id)" + fixed.MARKER

    def hit(text: Column, start: Column) -> Column:
        return let(start + F.length(F.regexp_extract(text, pattern, 0)) - 1, lambda end: F.aggregate(
            texts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("hit")),
            lambda s, t: F.struct((s["at"] + F.length(t)).alias("at"), (s["n"] + 1).alias("n"), F.when((s["hit"] < 0) & (s["at"] + F.length(t) >= end), s["n"]).otherwise(s["hit"]).alias("hit")),
        )["hit"])

    return let(F.array_join(texts, ""), lambda text: let(F.regexp_instr(text, F.lit(pattern)), lambda start: F.when(start > 0, hit(text, start))))


def stats(df: DataFrame, *, logprobs: str = "token_logprobs", texts: str = "tokens") -> DataFrame:
    """``df`` with min, mean and count of low values, of all tokens and of the answer's, and the lowest token with its context."""
    df = df.withColumn(logprobs, values(df, logprobs))
    lp, text = F.col(logprobs), F.col(texts)
    staged = df.withColumns({"_min": F.array_min(lp), "_start": answer_start(text)})
    staged = staged.withColumns({"_at": F.array_position(lp, F.col("_min")).cast("int"), "_answer": let(F.col("_start"), lambda at: F.when(at < F.size(lp), F.slice(lp, at + 1, F.size(lp))))})
    answer, at = F.col("_answer"), F.col("_at")
    first = F.greatest(F.lit(1), at - CONTEXT)
    out = staged.withColumns({
        "min_logprob": F.bround("_min", 4), "mean_logprob": F.bround(mean(lp), 4),
        "answer_min_logprob": F.bround(F.array_min(answer), 4), "answer_mean_logprob": F.bround(mean(answer), 4),
        "low_conf_token_count": F.when(F.size(lp) > 0, low(lp)).otherwise(F.lit(0).cast("long")),
        "lowest_logprob_token": F.get(text, at - 1),
        "lowest_logprob_context": F.when(F.col("_min").isNotNull(), F.array_join(F.slice(text, first, at + CONTEXT - first + 1), "")),
        "left_context": F.when(F.col("_min").isNotNull(), F.array_join(F.slice(text, first, at - first), "")),
        "right_context": F.when(F.col("_min").isNotNull(), F.array_join(F.slice(text, at + 1, F.lit(CONTEXT)), "")),
        "answer_low_conf_token_count": F.when(answer.isNotNull(), low(answer)).otherwise(F.lit(0).cast("long")),
        "answer_start": F.col("_start"), "logprob_source": F.when(F.size(lp) > 0, "inline").otherwise("missing"),
    })
    return out.drop("_min", "_start", "_at", "_answer")


def longest_run(a: Column, first: int = 20) -> Column:
    """The longest run of equal neighbours (to four digits) among the first values."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        x = F.bround(x, 4)
        run = F.when(x == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.slice(a, 1, first), start, step)["most"]


def degenerate(a: Column, run: int = 10, first: int = 20) -> Column:
    """Did generation repeat itself: ``run`` equal values in a row within the first?"""
    return F.coalesce(longest_run(a, first) >= run, F.lit(False))


def ranked(df: DataFrame, k: int, score: str, key: str, category: str = "category", correct: str = "is_correct") -> DataFrame:
    """Spec-derived: the ``k`` most brittle rows overall, of each category, and of right and of wrong answers: (list, rank, ...).

    Each row stands for its three lists in one pass; every list is a top-k, which tasks cut before anything is shuffled.
    """
    rows = df.where(F.col(score).isNotNull())
    lists = F.lit("overall"), F.col(category), F.when(F.col(correct), "correct").otherwise("incorrect")
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), x.alias("list")) for i, x in enumerate(lists)))
    each = rows.withColumn("_list", F.explode(kinds))
    order = W.partitionBy("_list").orderBy(score, key)
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("list", F.col("_list.list")).drop("_list")

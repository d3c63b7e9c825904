"""Nested training rows from verified samples, behind a validity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import filled, json_value, let
from ..sources.ingest import read_lines

SAID = fixed.PATCH_ERRORS


def _messages(*checks: tuple[Column, str | Column]) -> Column:
    said = [F.when(F.coalesce(bad, F.lit(True)), m if isinstance(m, Column) else F.lit(m)) for bad, m in checks]
    return F.filter(F.array(*said), lambda m: m.isNotNull())


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _unexpected(category: Column) -> tuple[Column, Column]:
    return ~F.coalesce(category.isin(*fixed.CRYPTARITHM_LABELS), F.lit(False)), filled(SAID["category"], F.coalesce(F.concat(F.lit("'"), category, F.lit("'")), F.lit("None")))


def sample_errors() -> Column:
    """What keeps a sample out of a patch."""
    c = F.col
    return _messages((~c("verified"), SAID["unverified_sample"]), _unexpected(c("category")), (_empty(c("question")), SAID["question"]), (_empty(c("solver_answer")), SAID["solver_answer"]), (_empty(c("reasoning_text")), SAID["reasoning_text"]))


def to_record(df: DataFrame) -> DataFrame:
    """(problem_id, category, messages, answer, metadata)."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    said = lambda role, name: F.struct(F.lit(role).alias("role"), text(name).alias("content"))
    mask = F.coalesce(F.col("mask_policy"), F.lit(fixed.MASK_POLICY)) if "mask_policy" in df.columns else F.lit(fixed.MASK_POLICY)
    return df.select(
        text("problem_id").alias("problem_id"), text("category").alias("category"), F.array(said("user", "question"), said("assistant", "reasoning_text")).alias("messages"), text("solver_answer").alias("answer"),
        F.struct(F.lit(fixed.PATCH_SOURCE).alias("source"), text("rule_type").alias("rule_type"), F.lit(True).alias("verified"), mask.alias("mask_policy")).alias("metadata"),
    )


def build(samples: DataFrame, *, order: str, max_rows: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(patch, rejected).  Rejected rows carry their ``errors``; ``strict`` raises if there are any.

    ``max_rows`` caps accepted rows in the order of ``order``: the cap is the feature.
    """
    judged = samples.withColumn("errors", sample_errors())
    good, bad = judged.where(F.size("errors") == 0), judged.where(F.size("errors") > 0)
    if strict and (first := bad.orderBy(order).select("problem_id", "errors").head()):
        raise ValueError(f"{first.problem_id}: {'; '.join(first.errors)}")
    if max_rows is not None:
        good = good.orderBy(order).limit(max_rows)
    return to_record(good), bad


def record_errors() -> Column:
    """What makes a patch row invalid."""
    m = F.col("messages")
    pair = F.size(F.coalesce(m, F.array().cast("array<struct<role:string,content:string>>"))) == 2
    checks = [_unexpected(F.col("category")), (_empty(F.col("answer")), SAID["answer"]), (~pair, SAID["messages"])]
    for k, role in enumerate(("user", "assistant")):
        at = F.get(m, F.lit(k))
        checks += [(pair & F.coalesce(at["role"] != role, F.lit(True)), SAID["role"] % (k + 1, role)), (pair & _empty(at["content"]), SAID["content"] % (k + 1))]
    checks += [(F.col("metadata").isNull(), SAID["metadata"]), (F.col("metadata").isNotNull() & ~F.coalesce(F.col("metadata")["verified"], F.lit(False)), SAID["unverified"])]
    return _messages(*checks)


def validate(patch: DataFrame, *, require_rows: bool = False) -> int:
    """The number of rows, or ValueError with the first errors."""
    n, bad = patch.agg(F.count(F.lit(1)), F.count_if(F.size(record_errors()) > 0)).first()
    if bad:
        shown = patch.withColumn("errors", record_errors()).where(F.size("errors") > 0).limit(5).collect()
        raise ValueError("; ".join(f"{r.problem_id}: {', '.join(r.errors)}" for r in shown))
    if require_rows and not n:
        raise ValueError(SAID["no_rows"])
    return n



def _kind(v: Column) -> Column:
    return F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit("VOID"))


def _nothing(v: Column) -> Column:
    """Absent, null, false, 0, or an empty text, list or object."""
    return v.isNull() | v.cast("string").isNull() | v.cast("string").isin("", "false", "0", "[]", "{}")


def line_errors(value: Column) -> Column:
    """What makes a line of a patch file invalid, whatever JSON it holds."""

    def of(v: Column) -> Column:
        get = lambda c, at, kind="variant": F.try_variant_get(c, at, kind)
        category, messages, metadata = get(v, "$.category"), get(v, "$.messages", "array<variant>"), get(v, "$.metadata")
        known = (_kind(category) == "STRING") & category.cast("string").isin(*fixed.CRYPTARITHM_LABELS)
        named = F.when(_kind(category) == "STRING", F.concat(F.lit("'"), category.cast("string"), F.lit("'"))).otherwise(F.coalesce(category.cast("string"), F.lit("None")))
        pair = F.coalesce((_kind(get(v, "$.messages")) == "ARRAY") & (F.size(messages) == 2), F.lit(False))
        checks = [(~known, filled(SAID["category"], named)), (_nothing(get(v, "$.answer")), SAID["answer"]), (~pair, SAID["messages"])]
        for k, role in enumerate(("user", "assistant")):
            m = F.get(messages, F.lit(k))
            thing = _kind(m) == "OBJECT"
            checks.append((pair & ~thing, SAID["message"] % (k + 1)))
            checks.append((pair & thing & ~get(m, "$.role", "string").eqNullSafe(F.lit(role)), SAID["role"] % (k + 1, role)))
            checks.append((pair & thing & _nothing(get(m, "$.content")), SAID["content"] % (k + 1)))
        described = _kind(metadata) == "OBJECT"
        true = (_kind(get(metadata, "$.verified")) == "BOOLEAN") & get(metadata, "$.verified", "boolean")
        checks += [(~described, SAID["metadata"]), (described & ~F.coalesce(true, F.lit(False)), SAID["unverified"])]
        said = lambda name: F.array(F.lit(SAID[name]))
        return F.when(v.isNull(), said("json")).when(_kind(v) != "OBJECT", said("object")).otherwise(_messages(*checks))

    return let(json_value(value), of)


def check_file(spark: SparkSession, path: str, *, folders: bool = False) -> DataFrame:
    """(_source_path, line, errors): every line of a patch that isn't blank, with what is wrong with it; a list, a number or broken JSON is an error.

    With ``folders`` a patch is a folder, and its lines are numbered through its files by their names.
    """
    lines = read_lines(spark, path, folders=folders).where(F.btrim("value", F.lit(" \t\r")) != "")
    return lines.select("_source_path", F.col("_line").alias("line"), line_errors(F.col("value")).alias("errors"))

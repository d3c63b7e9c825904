"""Markdown reports over small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..operators import aggregate
from ..sources.sinks import markdown, markdown_of


#: Rows of a report's lists; the limits are the report's.
WEAKEST, PRIORITIES, GROUPS, KINDS, CASES = 5, 5, 20, 5, 10
GROUP_FIELDS = ["category", "subcategory", "n", "accuracy", "avg_min_logprob", "n_wrong_low_conf", "n_correct_low_conf", "priority_score"]


def of_split(rows: DataFrame, split: str = "category") -> DataFrame:
    """Rows of a split; those without one, or in tables without the column, are of the categories'."""
    return rows.where(F.coalesce(F.col("split"), F.lit("category")) == split) if "split" in rows.columns else rows


def _shown(c: str, kind: T.DataType) -> Column:
    return F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.4f", c) if isinstance(kind, T.DoubleType) else F.col(c).cast("string"))


def _listed(df: DataFrame, section: Column | str, fields: list[str], order: list[Column], limit: int) -> DataFrame:
    """(section, place, cells): the first ``limit`` rows of each section."""
    section = F.lit(section) if isinstance(section, str) else section
    shown = F.array(*(_shown(c, df.schema[c].dataType) for c in fields))
    ranked = df.select(section.alias("section"), shown.alias("cells"), F.row_number().over(W.partitionBy(section).orderBy(*order)).alias("place"))
    return ranked.where(F.col("place") <= limit).select("section", "place", "cells")


def lists(summary: DataFrame, groups: DataFrame, kinds: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(section, place, cells): everything a report shows, each list cut where it is made.

    ``scored`` has one row for each problem with is_correct and answer_min_logprob: its protected cases are right with little confidence, its replay
    cases wrong with very little.
    """
    of_category = of_split(groups)
    name = ["category", "subcategory"]
    first = [F.desc("priority_score"), *name]
    parts = [
        _listed(aggregate.overall_row(summary, "category"), "overall", ["n", "accuracy", "parse_success_rate", "avg_generation_token_count"], [F.lit(1)], 1),
        _listed(of_category, "weakest", [*name, "accuracy", "n"], [F.asc_nulls_last("accuracy"), *name], WEAKEST),
        _listed(groups, "priorities", [*name, "priority_score", "priority_reason"], first, PRIORITIES),
        _listed(of_category, "groups", GROUP_FIELDS, first, GROUPS),
        _listed(kinds, F.concat(F.lit("failures of "), "category"), ["failure_type", "count", "pct"], [F.desc("count"), "failure_type"], KINDS),
    ]
    if scored is not None:
        low = {"protected": F.col("is_correct") & (F.col("answer_min_logprob") < fixed.LOW_LOGPROB), "replay": ~F.col("is_correct") & (F.col("answer_min_logprob") < fixed.BOOST_LOGPROB)}
        tagged = scored.select("*", F.when(low["protected"], "protected").when(low["replay"], "replay").alias("kind")).where("kind is not null")
        parts.append(_listed(tagged, F.concat("kind", F.lit(" cases")), ["problem_id", "category", "answer_min_logprob"], [F.col("answer_min_logprob"), F.col("problem_id")], CASES))
        parts.append(_listed(tagged.groupBy("kind", "category").count(), F.concat("kind", F.lit(" counts")), ["category", "count"], [F.desc("count"), "category"], GROUPS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def recommendation(summary: DataFrame, groups: DataFrame, kinds: DataFrame, scored: DataFrame | None = None) -> str:
    """The report's Markdown: all its lists are collected together, in one job."""
    found: dict[str, list[list[str]]] = {}
    for r in sorted(lists(summary, groups, kinds, scored).collect(), key=lambda r: (r.section, r.place)):
        found.setdefault(r.section, []).append(r.cells)

    def table(section: str, headers: list[str], none: str = "No rows.") -> str:
        return markdown(headers, found[section]) if section in found else none

    overall = (found.get("overall") or [["N/A"] * 4])[0]
    text = [
        "# Analysis report", "## Summary", markdown(["Metric", "Value"], zip(["Problems", "Accuracy", "Parse success rate", "Average tokens"], overall, strict=True)),
        "### Weakest categories", "\n".join(f"- `{c}/{s}`: accuracy {a} (n = {n})" for c, s, a, n in found.get("weakest", [])),
        "### First priorities", "\n".join(f"- `{c}/{s}`: priority {p}, {why}" for c, s, p, why in found.get("priorities", [])),
        "## Failures by category", table("groups", GROUP_FIELDS),
    ]
    for section in sorted(s for s in found if s.startswith("failures of ")):
        text += [f"## {section.removeprefix('failures of ')}: commonest failures", markdown(["failure_type", "count", "pct"], [[t, n, f"{p}%"] for t, n, p in found[section]])]
    for kind, title in (("protected", "Protected cases: right with little confidence"), ("replay", "Replay cases: wrong with very little confidence")):
        if scored is not None:
            text += [f"## {title}", table(f"{kind} counts", ["category", "count"]), "### Least confident", table(f"{kind} cases", ["problem_id", "category", "answer_min_logprob"])]
    return "\n\n".join(text) + "\n"


def coverage(solved: DataFrame, order: str = "problem_id") -> str:
    """What a rule solver verified, by category and kind of failure, with the first mismatches."""
    labels = aggregate.label_counts(solved, "failure_type", empty="verified", order=order).orderBy("rank")
    notes = aggregate.label_counts(solved.where("not verified"), "solver_notes", empty="", order=order, most=10).orderBy("rank")
    misses = solved.where("failure_type = 'answer mismatch'").orderBy(order).limit(5).select("problem_id", "rule_type", "normalized_answer", "solver_answer")
    parts = [("Coverage", aggregate.coverage(solved).orderBy("category")), ("Outcomes", labels), ("Solver notes", notes), ("First mismatches", misses)]
    return "\n\n".join(["# Verified coverage", *(f"## {title}\n\n{markdown_of(df)}" for title, df in parts)]) + "\n"

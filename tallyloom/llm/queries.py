"""Queries over the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, language_id, language_model, line_dedup, mixing, near_dedup, nearest, quality, resampling, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_nearest_neighbours": nearest.op3,
    "op4_quality": quality.op4,
    "op5_toxicity": toxicity.op5,
    "op6_language_model": language_model.op6,
    "op7_language_id": language_id.op7,
    "op8_mixing": mixing.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_token_counts": token_counts.op10,
    "op11_centroid_clustering": centroids.op11,
    "op12_importance_resampling": resampling.op12,
    "op13_url_filter": url_filter.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_centroid_clustering": centroids.OP11_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}

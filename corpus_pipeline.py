"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate and mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder
and reads them back as the next stage's documents.  All stages but the last return the columns of their input.

Edge cases: documents without text or without an id pass the filters (they are neither toxic, near copies nor contaminated), a null
text stays null, and the mix takes no words of empty ones, so they don't come out of the last stage.  Of repeated rows one stays from
the third stage on; of an id with several texts every text that isn't a near copy of another stays.  Extra columns pass through all
stages whatever their names; the last stage replaces those named as one of its results.  Without labels of both kinds no
document is called toxic unless all labels are.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from tallyloom.llm.frames import discard, materialise, set_aside, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model fitted on the labelled rows of its input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten documents or more share; n_chars follows the text."""
    held, back = set_aside(docs, {"n_lines", "n_dropped"})
    kept = line_dedup.dedup_lines(held)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no more than the contract's part with benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model is trained, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES:
        out = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        docs = written = out
    return docs

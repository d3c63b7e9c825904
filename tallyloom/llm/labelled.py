"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, give_back, map_arrow, materialise, remainder

#: Bounds of a sample: labelled ids, bytes of their texts together, and bytes of one text (longer ones take no part in fitting).
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
LONGEST = 1 << 20
FOLDS, HELD_OUT = 5, 0


def sample(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS, longest: int = LONGEST, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(draw, id, label, text) of the ``bound`` labelled ids outside the held-out fold whose hashes come first.

    Null labels and ids are left out; an id that is labelled twice takes its larger label, and of several texts of one id the one
    whose hash comes first stands for it.  Null texts are empty.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (remainder(doc_id, folds) != held_out)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("long").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64("id", F.lit("labelled sample")), F.lit(1 << 30))
    # a little more than the bound passes the filter, so that few rows are sorted
    some = min(1.0, (bound + 6 * bound**0.5) / max(n, 1))
    chosen = known.withColumn("draw", draw).where(F.col("draw") < int((1 << 30) * some)).orderBy("draw", "id").limit(bound)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    # at most ``bound`` ids
    met = texts.join(F.broadcast(chosen), "id")
    return met.groupBy("draw", "id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fitted(rows: DataFrame, fit: Callable[[pa.Array, np.ndarray], object], *, most_bytes: int = SAMPLE_BYTES) -> object:
    """A model of a bounded sample, fitted in one task; the driver gets the model alone.

    Rows come in the order of their draws, as many as ``most_bytes`` of text hold, so the model doesn't depend on partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, texts, size = [], [], 0
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                size += len(b.as_buffer())
                if size <= most_bytes:
                    labels.append(a.as_py())
                    texts.append(b.as_py())
        column = pa.array(texts, pa.string())
        del texts
        model = fit(column, (np.array(labels, np.int64) > 0).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    drawn = materialise(rows, "labelled-sample")
    one = drawn.repartition(1).sortWithinPartitions("draw", "id").select("label", "text")
    found = map_arrow(one, run, "model binary").collect()
    discard(drawn)
    model = pickle.loads(bytes(found[0].model)) if found else fit(pa.array([], pa.string()), np.zeros(0, np.int64))
    give_back()
    return model


def squash(raw: np.ndarray, cut: float, at: float) -> np.ndarray:
    """Raw scores as numbers from 0 to 1, with ``cut`` at ``at``."""
    return 1 / (1 + np.exp(-np.clip(raw - cut + np.log(at / (1 - at)), -40, 40)))

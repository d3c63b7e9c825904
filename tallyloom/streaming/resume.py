"""Incremental scoring of predictions as files arrive, with restart recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import answers_match, extract_answer, parse_error_type
from ..sources.ingest import exists


def arriving(spark: SparkSession, folder: str, schema: T.StructType | str, *, files_each: int = 100) -> DataFrame:
    """Rows of JSONL files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)


def scored(rows: DataFrame, *, key: str = "problem_id", event_time: str | None = None, delay: str = "1 hour", once: bool = True) -> DataFrame:
    """Each problem once, with its extracted answer.

    With an event time, keys are forgotten once the watermark has passed them, so state stays bounded.  Without one, all keys are state; rather leave
    repeats to ``append_once`` with ``once=False``, which keeps none.
    """
    if once:
        rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])
    x = rows.withColumn("_x", extract_answer(F.col("raw_output")))
    pred = F.col("_x.pred_answer")
    return x.withColumns({"pred_answer": pred, "is_correct": answers_match(pred, F.col("gold_answer")), "parse_error_type": parse_error_type(pred, F.col("raw_output"))}).drop("_x")


def append_once(rows: DataFrame, path: str, checkpoint: str, key: str = "problem_id") -> StreamingQuery:
    """Each key once, exactly, without state: a batch leaves out keys that earlier batches wrote, and replaces what it wrote itself.

    Rows go to a folder for each batch, so a batch that runs again after a failure between the sink and the checkpoint gives the same table.
    Earlier keys are read from the sink's one column and joined, whatever their number; of rows of one key in a batch one stays.
    """
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        done = batch.sparkSession.read.schema(schema).parquet(path) if exists(batch.sparkSession, path) else None
        fresh = batch.dropDuplicates([key])
        if done is not None:
            fresh = fresh.join(done.where(F.col("_batch") < number).select(key), key, "left_anti")
        fresh.select(*names).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All files there are, then stop; a restart goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

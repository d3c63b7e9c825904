"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_runs = itertools.count()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset on a single machine the session gets one under its warehouse; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors share no folder")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyloom/{name}-{next(_runs)}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if "/tallyloom/" in folder:
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents``, dealt over all cores where the table has fewer files than there are cores; others stay as they are scanned."""
    df, cores = table(spark, sf_dir, "documents").select(*columns), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: set[str], keep: str | None = None) -> DataFrame:
    """``df`` without columns named as one of ``names`` in any case, but for the column ``keep``."""
    return df.select(*(F.col(quoted(c)) for c in df.columns if c == keep or c.lower() not in {n.lower() for n in names}))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def set_aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, list]:
    """``df`` with columns named as one of ``names`` renamed, and the columns that give the first form back."""
    renamed = {}
    for c in df.columns:
        if c.lower() in names:
            renamed[c] = free_name(df, f"_{c}")
    return df.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in df.columns]


def give_back() -> None:
    """Return freed memory of this process to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in workers that give memory back after each task."""

    def and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(and_give_back, schema)


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo ``n``: the folds of the held-out rows; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))

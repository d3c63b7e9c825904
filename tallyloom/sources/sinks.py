"""Sinks: CSV with fixed columns, JSONL with sorted keys, and Markdown tables of small results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMITS = {"raw_output": 4000, "reasoning_text": 3000}
MARK = " ...[truncated]"


def write_csv(df: DataFrame, path: str, fields: list[str], *, strict: bool = False, single: bool = False, mode: str = "overwrite") -> None:
    """Exactly ``fields``, in order; ``strict`` refuses further columns.  ``single`` makes one file of a small result."""
    extra = [c for c in df.columns if c not in fields]
    if strict and extra:
        raise ValueError(f"columns without a field: {extra}")
    out = df.select(*fields)
    (out.coalesce(1) if single else out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_groups(df: DataFrame, path: str, by: str) -> None:
    """Appends groups of ``by``; a group that is there already is replaced, others stay, so a step may run again after any failure."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_text_groups(df: DataFrame, path: str, by: str, order: str) -> None:
    """Lines in ``value`` as a folder of text files for each group of ``by``; in the order of the files' names, lines are in that of ``order``.

    Groups are cut by ranges of ``order``, so a large one goes to several tasks and files.
    """
    df.repartitionByRange(by, order).sortWithinPartitions(by, order).select(by, "value").write.partitionBy(by).text(path)


def export_csv(df: DataFrame, path: str, fields: list[str], order: list[str]) -> None:
    """A small result as one sorted CSV file with its header once."""
    df.select(*fields).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _sorted(kind: T.DataType, c):
    """Structs with their fields by name, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_sorted(kind[n].dataType, c[n]).alias(n) for n in sorted(kind.names))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted(kind.elementType, x))
    return c


def jsonl(df: DataFrame) -> DataFrame:
    """One JSON text for each row, keys in order, nulls written."""
    fields = [_sorted(df.schema[c].dataType, F.col(c)).alias(c) for c in sorted(df.columns)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite", single: bool = False) -> None:
    out = jsonl(df)
    (out.coalesce(1) if single else out).write.mode(mode).text(path)


def shortened(predictions: DataFrame) -> DataFrame:
    """Long outputs cut with a mark, and without the generation's configuration."""
    cut = {c: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(MARK))).otherwise(F.col(c)) for c, n in LIMITS.items() if c in predictions.columns}
    return predictions.withColumns(cut).drop("generation_config")


def write_predictions(predictions: DataFrame, path: str, *, mode: str = "append") -> None:
    """Appends by default, so an interrupted run keeps what it has."""
    write_jsonl(shortened(predictions), path, mode=mode)


def markdown(headers: list[str], rows: Iterable[Iterable[object]]) -> str:
    shown = [headers, ["---"] * len(headers), *rows]
    return "\n".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in shown)


def markdown_of(df: DataFrame, limit: int = 50) -> str:
    """A small result as a table; the limit is the report's."""
    return markdown(df.columns, (tuple(r) for r in df.limit(limit).collect()))

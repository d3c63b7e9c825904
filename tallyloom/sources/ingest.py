"""Scans of JSONL and CSV problem sets, and resolution of their fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.text import canonical_json, json_value, length_summary, operator_symbols
from ..operators.joins import first_present, flag_members
from .scratch import written


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def first_existing(spark: SparkSession, paths: Iterable[str], pattern: str | None = None) -> str | None:
    """The first path that exists, else the last in order of what a glob finds (versions count up)."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found or pattern is None:
        return found
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return max((str(s.getPath()) for s in status), default=None)


def numbered(df: DataFrame, name: str = "_ord") -> DataFrame:
    """``df`` with the rows' numbers from 0 in the order of the scan.

    The rows are written once, so that numbers hold whatever becomes of what ``df`` reads.  A row's number is its place in its partition and what
    stands before that, which is counted in the written table's one narrow column.
    """
    at = written(df.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = at.withColumn("_part", part).join(before, "_part")
    return joined.select(*df.columns, (F.col("_before") + place).alias(name))


def read_lines(spark: SparkSession, path: str, *, folders: bool = False) -> DataFrame:
    """(value, _source_path, _line): lines of text files with their numbers from 1 in their file, with ``folders`` through a folder's files by their names.

    The files are scanned once, whatever blocks they are read in; blocks are counted in narrow columns of what the scan wrote.
    """
    block = ["_source_path", "_start"]
    scan = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_path"), F.col("_metadata.file_block_start").alias("_start"))
    at = written(scan.withColumn("_id", F.monotonically_increasing_id()))
    blocks = at.groupBy(*block).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # rows of a block follow each other
    whole = F.regexp_replace("_source_path", "[^/]*$", "") if folders else F.col("_source_path")
    order = W.partitionBy(whole).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(*block, (F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return at.join(before, block).select("value", "_source_path", (F.col("_id") + F.col("_shift")).alias("_line"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, strict: bool = True, ordered: bool = False, line_numbers: bool = False, folders: bool = False) -> DataFrame:
    """Objects of a JSONL file with ``_source_path``; blank lines and other JSON values are skipped.

    ``strict`` raises for a malformed line with its file and, with ``line_numbers``, its number; otherwise such lines are skipped.
    ``line_numbers`` adds ``_line`` (with ``folders`` through each folder's files), ``ordered`` adds ``_ord``, the number among all lines that aren't blank.
    """
    lines = read_lines(spark, path, folders=folders) if line_numbers else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_path"))
    place = F.concat("_source_path", F.lit(":"), F.col("_line").cast("string")) if line_numbers else F.col("_source_path")
    lines = lines.where(F.btrim("value", F.lit(" \t\r")) != "")
    lines = numbered(lines) if ordered else lines
    parsed = lines.withColumn("_any", json_value(F.col("value")))
    if strict:
        bad = F.raise_error(F.concat(place, F.lit(": malformed JSON line: "), F.substring("value", 1, 80)))
        parsed = parsed.withColumn("value", F.when(F.col("_any").isNull(), bad).otherwise(F.col("value")))
    objects = parsed.where(F.startswith(F.ltrim("value"), F.lit("{"))).withColumn("_row", F.from_json("value", schema)).where(F.col("_row").isNotNull() & (F.lit(True) if strict else F.col("_any").isNotNull()))
    return objects.select("_row.*", "_source_path", *(["_line"] if line_numbers else []), *(["_ord"] if ordered else []))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Predictions, or no rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema).drop("_source_path")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; an empty cell is an empty text.  A missing file has neither rows nor columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([]))
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return df.fillna("")


def with_aliases(df: DataFrame, ordered: str | None = None) -> DataFrame:
    """Text columns question, answer and problem_id by whichever name (in whatever case) comes first; others stay.

    Without an id column, ``row_`` and the number in ``ordered`` stands for it.
    """
    by_low = {c.lower(): c for c in reversed(df.columns)}
    chosen = {field: next((by_low[n] for n in names if n in by_low), None) for field, names in fixed.CSV_ALIASES.items()}
    out = df
    for field, name in chosen.items():
        if name:
            out = out.withColumn(field, F.col(f"`{name}`"))
    if not chosen["problem_id"] and ordered:
        out = out.withColumn("problem_id", F.concat(F.lit("row_"), F.col(ordered).cast("string")))
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that some lack is null there."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def load(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Problem sets of either format, by suffix; missing files are skipped."""
    frames = [with_aliases(read_csv(spark, p)) if p.lower().endswith(".csv") else read_jsonl(spark, p, schema) for p in paths if exists(spark, p)]
    return union(frames) if frames else spark.createDataFrame([], schema)


def completed_ids(spark: SparkSession, path: str, key: str = "problem_id") -> DataFrame:
    """Ids of finished rows; lines that an interrupted run left broken are skipped."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema, strict=False).select(key).where(F.col(key).isNotNull()).distinct()


def present(df: DataFrame, names: Iterable[str], default: str = "") -> Column:
    return first_present(*(F.col(n) if isinstance(df.schema[n].dataType, T.AtomicType) else F.to_json(n) for n in names if n in df.columns), default=default)


def first_column(df: DataFrame, names: Iterable[str], default: str = "") -> Column:
    """The first column that exists, even if its value is empty: presence, not truth."""
    return next((F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names if n in df.columns), F.lit(default))


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select(present(df, fixed.ID_NAMES).alias("id")).where("id <> ''").distinct()


def detect_category(df: DataFrame) -> Column:
    """An exact label in one of the fields, else one that occurs anywhere in the record (deduce before guess)."""
    exact = [F.when(F.col(n).isin(*fixed.CRYPTARITHM_LABELS), F.col(n)) for n in fixed.CATEGORY_NAMES if n in df.columns]
    blob = F.lower(F.to_json(F.struct(*df.columns)))
    return F.coalesce(*exact, *(F.when(F.contains(blob, F.lit(c)), F.lit(c)) for c in fixed.CRYPTARITHM_LABELS), F.lit(""))


def inventory(records: DataFrame, corpus: DataFrame, ordered: str | None = None) -> DataFrame:
    """Letter-arithmetic problems with resolved fields, length summary, operator symbols, and whether the corpus holds them."""
    order = F.col(ordered).cast("string") if ordered else F.lit("0")
    ids = F.coalesce(F.nullif(present(records, fixed.ID_NAMES), F.lit("")), F.concat(F.lit("row_"), order))
    rows = records.select(
        ids.alias("problem_id"), detect_category(records).alias("category"), present(records, fixed.QUESTION_NAMES).alias("question"), present(records, fixed.ANSWER_NAMES).alias("answer"),
        canonical_json(present(records, fixed.EXAMPLE_NAMES)).alias("examples"), present(records, ["_source_path"]).alias("source_path"),
    ).where(F.col("category").isin(*fixed.CRYPTARITHM_LABELS))
    joined = F.concat_ws("\n", "question", "examples", "answer")
    rows = rows.withColumns({"input_output_length": length_summary(F.col("question"), F.col("examples"), F.col("answer")), "operator_symbols": operator_symbols(joined)})
    known = corpus.select(F.col("problem_id").cast("string").alias("problem_id"))
    flagged = flag_members(rows, known, "problem_id", "current_corpus_included")
    return flagged.select("problem_id", "category", "question", "answer", "examples", "input_output_length", "operator_symbols", "current_corpus_included", "source_path")


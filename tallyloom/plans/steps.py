"""Named pipeline steps in one session: selection, dependencies, gates, fallbacks, kept results, and a table of what each took."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, failures, logprob
from ..sources.ingest import exists


@dataclass
class Step:
    """``when`` is asked with the numbers of rows so far, by step; ``version`` changes with what ``run`` does."""

    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    when: Callable[[dict[str, int]], bool] | None = None
    version: str = "1"


def mark_of(df: DataFrame) -> str:
    """Schema and files (with sizes and times) that a frame reads; a new one each time where it reads none."""
    spark, seen = df.sparkSession, hashlib.sha256(df.schema.json().encode())
    files = sorted(df.inputFiles())
    for f in files:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        seen.update(f"{f} {status.getLen()} {status.getModificationTime()}".encode())
    return seen.hexdigest() if files else f"{time.time_ns()}"


@dataclass
class Runner:
    """Runs steps in order.  A failed step is logged and later ones still run, but for those that need its result.

    With a ``folder`` each step's frame is written there under a mark of its name, version and inputs; a step whose result is there is
    not run again, as after an interrupted run.  Rows are observed as they are written.
    """

    steps: list[Step]
    log: list[dict] = field(default_factory=list)
    folder: str | None = None

    def run(self, results: dict | None = None, *, only: Iterable[str] | None = None, skip: Iterable[str] = ()) -> dict:
        results, only, skip = dict(results or {}), None if only is None else set(only), set(skip)
        marks = {n: mark_of(r) for n, r in results.items() if isinstance(r, DataFrame)} if self.folder else {}
        rows: dict[str, int] = {}
        for step in self.steps:
            began, status, said = time.perf_counter(), "ok", ""
            missing = [n for n in step.needs if n not in results]
            if step.name in skip or (only is not None and step.name not in only):
                status = "skipped"
            elif missing:
                status, said = "blocked", f"needs {', '.join(missing)}"
            elif step.when is not None and not step.when(rows):
                status = "gated"
            else:
                try:
                    status = self._run(step, results, marks, rows)
                except Exception as e:  # one step's failure is a row of the log
                    status, said = "failed", str(e)
            self.log.append({"step": step.name, "status": status, "rows": rows.get(step.name), "seconds": round(time.perf_counter() - began, 3), "message": said})
        return results

    def _run(self, step: Step, results: dict, marks: dict[str, str], rows: dict[str, int]) -> str:
        if self.folder is None:
            results[step.name] = step.run(results)
            return "ok"
        mark = marks[step.name] = hashlib.sha256(" ".join([step.name, step.version, *(marks.get(n, "") for n in step.needs)]).encode()).hexdigest()
        path = f"{self.folder}/{step.name}-{mark[:24]}"
        spark = next(r.sparkSession for r in results.values() if isinstance(r, DataFrame))
        if exists(spark, f"{path}/_SUCCESS"):
            results[step.name] = spark.read.parquet(path)
            rows[step.name] = results[step.name].count()  # from the files' footers
            return "kept"
        made = step.run(results)
        if isinstance(made, DataFrame):
            seen = Observation(step.name)
            made.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
            rows[step.name], made = seen.get["rows"], spark.read.schema(made.schema).parquet(path)
        results[step.name] = made
        return "ok"

    def metrics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "step string, status string, rows long, seconds double, message string")


def inline_or(rows: DataFrame, fallback: Callable[[], DataFrame], column: str = "min_logprob") -> DataFrame:
    """``rows`` if any has a value, else what the fallback gives."""
    return fallback() if rows.where(f"{column} is not null").isEmpty() else rows


def analysis(order: str = "problem_id", folder: str | None = None) -> Runner:
    """Statistics, priorities and failure cases of a ``predictions`` and a ``tokens`` table; cases only where there are priorities."""
    joined = lambda r: r["predictions"].join(r["logprob"].drop("token_logprobs", "tokens"), "problem_id", "left")
    steps = [
        Step("summary", lambda r: aggregate.rollup(r["predictions"], "category", "subcategory"), ("predictions",)),
        Step("logprob", lambda r: logprob.stats(r["tokens"]), ("tokens",)),
        Step("priority", lambda r: aggregate.with_priority(aggregate.failure_groups(joined(r))), ("predictions", "logprob")),
    ]
    prior = lambda rows: rows.get("priority") != 0
    for category in failures.PROCESSES:
        steps.append(Step(f"cases_{category}", lambda r, c=category: failures.cases(joined(r), c, order=order, include_fragile=c == "cryptarithm"), ("predictions", "logprob"), prior))

    def kinds(r: dict) -> DataFrame:
        return aggregate.counts_with_share(failures.all_cases(joined(r), order=order), "category", "failure_type", within="category")

    return Runner([*steps, Step("failure_types", kinds, ("predictions", "logprob"), prior)], folder=folder)

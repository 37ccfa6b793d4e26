"""Reports of a benchmark run, and its resumable state."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.operators import evaluation as ev


def fingerprint(config: dict, sample_ids: list[str]) -> str:
    """The same for the same settings, whatever the order of the samples."""
    return hashlib.sha256(json.dumps(config | {"sample_ids": sorted(sample_ids)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def keyed(results: DataFrame) -> DataFrame:
    return results.withColumn("key", F.concat_ws(":", "category", "question"))


def remaining(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions to ask: not of category 5, and without a result."""
    done = keyed(results).select("sample_id", "key").distinct()
    return keyed(questions.filter("category <> 5")).join(done, ["sample_id", "key"], "left_anti")


def save(results: DataFrame, path: str, mark: str) -> None:
    """Results under the run's fingerprint, so that only the same run goes on from them."""
    results.withColumn("run", F.lit(mark)).write.mode("append").partitionBy("run").parquet(path)


def load(spark, path: str, mark: str, schema) -> DataFrame:
    try:
        return spark.read.parquet(path).filter(F.col("run") == mark).drop("run")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def percent(value: float) -> str:
    return f"{value * 100:.2f}%"


def markdown(results: DataFrame) -> str:
    """A table of the means: one row for each category and one for all. Only these few rows reach the driver."""
    rows = ev.by_category(results).orderBy("category").collect()
    total = results.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ev.METRICS]).first()
    lines = ["| category | n | " + " | ".join(ev.METRICS) + " |", "| --- | --- | " + " | ".join("---" for _ in ev.METRICS) + " |"]
    for name, r in [*((str(r["category"]), r) for r in rows), ("all", total)]:
        lines.append(f"| {name} | {r['n']} | " + " | ".join(percent(r[m]) for m in ev.METRICS) + " |")
    return "\n".join(lines) + "\n"


def write(results: DataFrame, path: str) -> None:
    """Summaries as JSON."""
    ev.summaries(results).write.mode("overwrite").json(path)

"""Sessions by event time in a stream: windows that close behind a watermark, and what comes too late for them kept apart.

Batches first pass a gate. A row is late if its time lies more than the delay behind the newest row of all batches before its own; such rows go to a
table of their own, by batch. So the windows behind the gate, under the same delay, get every row they are for, and nothing is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _newest(spark: SparkSession, path: str, before: int):
    """The newest time that the gate has seen in batches before this one; null at first."""
    if before == 0:
        return None
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < before).agg(F.max("newest")).first()[0]


def gate(messages: DataFrame, delay: str, path: str) -> DataStreamWriter:
    """A writer that splits a stream with a time column `ts` into the folders `timely` and `late` below path. A batch run again writes what it wrote."""
    spark = messages.sparkSession

    def stage(batch: DataFrame, batch_id: int) -> None:
        newest = _newest(spark, f"{path}/seen", batch_id)
        late = F.lit(False) if newest is None else F.coalesce(F.col("ts") <= F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/timely/batch={batch_id}")

    return messages.writeStream.foreachBatch(stage)


def sessions(messages: DataFrame, gap: str, delay: str) -> DataFrame:
    """conversation_id, n, start_seq, end_seq of each session, once nothing timely can join it any more."""
    windows = messages.withWatermark("ts", delay).groupBy("conversation_id", F.session_window("ts", gap))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq")).drop("session_window")

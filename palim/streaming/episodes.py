"""The stage behind live segmentation: each batch of new spans becomes episodes.

A batch is written to a folder named by its id, over what may be there from a run that ended before its commit. So a batch that Spark
replays doubles nothing; and as spans reach the stage in one batch each, every episode is in one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from palim.operators import episodes as ep


def episode_stage(spans: DataFrame, messages: DataFrame, path: str) -> DataStreamWriter:
    """A writer that turns batches of spans (a stream of conversation_id, start_seq, end_seq, classification) into episodes of the logged messages, in folders of their own."""

    def stage(batch: DataFrame, batch_id: int) -> None:
        # Only the conversations of the batch are read further; both sides stay as large as they are, so Spark picks the join.
        wanted = messages.join(batch.select("conversation_id").distinct(), "conversation_id", "left_semi")
        ep.materialize(wanted, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return spans.writeStream.foreachBatch(stage)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of all batches."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """Takes back the last batch's commit from a checkpoint, as if the stream had ended just before it: the next start runs that batch again, under its id."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()]
    last = max(numbers)
    for name in (str(last), f".{last}.crc"):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), False)

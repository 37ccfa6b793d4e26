"""Episodes: spans made into records with rendered content, and their deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.functions import fsrs
from palim.functions.ids import episode_id
from palim.functions.text import tokens, transcript


def in_spans(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """Messages with the span that holds them: an equality on conversation and a closed range of seq.

    Spans of a conversation are cut into ranges of 1024 seqs, so that the join is an equality in all its keys.
    """
    width = 1024
    pieces = spans.withColumn("__part", F.explode(F.sequence(F.floor(F.col("start_seq") / width), F.floor(F.col("end_seq") / width))))
    keyed = messages.withColumn("__part", F.floor(F.col("seq") / width))
    return keyed.join(pieces, ["conversation_id", "__part"]).filter(F.col("seq").between(F.col("start_seq"), F.col("end_seq"))).drop("__part")


def materialize(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """One record for each span: ordered messages, first and last time (by seq), content, title and initial review state.

    A span without messages is an error; it has no row here, and `missing_spans` lists it.
    """
    placed = in_spans(messages, spans)
    grouped = placed.groupBy("conversation_id", "start_seq", "end_seq", "classification").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "content", "ts"))).alias("messages"))
    content = transcript(F.col("messages"))
    first, last = F.col("messages")[0], F.element_at("messages", -1)
    made = grouped.withColumn("content", content).withColumn("start_at", first["ts"]).withColumn("end_at", last["ts"])
    return made.select(
        episode_id(F.col("conversation_id"), F.col("start_seq")).alias("id"), "conversation_id", "start_seq", "end_seq", "classification", "messages", "content",
        title_stub(F.concat_ws(" ", F.transform("messages", lambda m: m["content"]))).alias("title"), "start_at", "end_at",
        F.lit(fsrs.INITIAL_STABILITY).alias("stability"), F.lit(fsrs.INITIAL_DIFFICULTY).alias("difficulty"), F.lit(0.0).alias("surprise"),
    )


def missing_spans(messages: DataFrame, spans: DataFrame) -> DataFrame:
    found = in_spans(messages, spans).select("conversation_id", "start_seq").distinct()
    return spans.join(found, ["conversation_id", "start_seq"], "left_anti")


def title_stub(text: Column) -> Column:
    """The offline title: the first 12 tokens."""
    return F.array_join(F.slice(tokens(text), 1, 12), " ")


def stale_jobs(jobs: DataFrame, spans: DataFrame) -> DataFrame:
    """Jobs (conversation_id, start_seq, end_seq) with whether they are current: the span exists and ends where the job says."""
    there = spans.select("conversation_id", "start_seq", F.col("end_seq").alias("span_end"))
    return jobs.join(there, ["conversation_id", "start_seq"], "left").withColumn("current", F.coalesce(F.col("span_end") == F.col("end_seq"), F.lit(False)))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows of incoming whose id isn't there yet; of several with one id, one."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def to_consolidate(episodes: DataFrame) -> DataFrame:
    return episodes.filter("classification = 'informative' AND consolidated_at IS NULL")


def valid_at(start_at: Column, end_at: Column) -> Column:
    return F.greatest(end_at, start_at)

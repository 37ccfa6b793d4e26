"""The review loop: pending retrievals, due memories, ratings and new memory states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim.functions import fsrs
from palim.functions.text import parse_rating
from palim.operators.ordered import numbered_in_parts
from palim.operators.retrieval import whole_days


def unconsumed(queue: DataFrame) -> DataFrame:
    """The queue in its order."""
    return queue.filter("consumed_at IS NULL").orderBy("created_at", "id")


def drain(queue: DataFrame, now: Column) -> DataFrame:
    """The queue after all waiting rows are taken."""
    return queue.withColumn("consumed_at", F.coalesce("consumed_at", now))


def asked(queue: DataFrame) -> DataFrame:
    """memory_id, position and query: the queries of each memory in order of arrival (from 0), repeats kept. A memory that everybody asks for is numbered in parts, by hours."""
    rows = queue.select("created_at", "id", "query", F.posexplode("memory_ids").alias("place", "memory_id"))
    rows = rows.withColumn("__hour", F.floor(F.unix_seconds("created_at") / 3600))
    numbered = numbered_in_parts(rows, "memory_id", "__hour", ["created_at", "id", "place"], "position")
    return numbered.select("memory_id", "position", "query")


def wanted(queue: DataFrame) -> DataFrame:
    """memory_id of all memories that were asked for, each once, and how often: counts are summed before they are dealt out."""
    return queue.select(F.explode("memory_ids").alias("memory_id")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


def eligible(wanted: DataFrame, memories: DataFrame, reviewed_at: Column) -> DataFrame:
    """Memories that exist, were last reviewed before, and at least a whole day ago."""
    both = wanted.join(memories, wanted["memory_id"] == memories["id"]).withColumn("days", whole_days(reviewed_at, F.col("last_reviewed_at")))
    return both.filter((reviewed_at > F.col("last_reviewed_at")) & (F.col("days") >= 1))


def apply(due: DataFrame, ratings: DataFrame, reviewed_at: Column) -> DataFrame:
    """ratings: memory_id, place, rating. Unknown ids are dropped; the first rating of an id counts."""
    order = Window.partitionBy("memory_id").orderBy("place")
    first = ratings.withColumn("n", F.row_number().over(order)).filter("n = 1").select("memory_id", parse_rating(F.col("rating")).alias("rating"))
    both = due.join(first, "memory_id")
    grade = F.lit(3)
    for name, value in fsrs.GRADES.items():
        grade = F.when(F.col("rating") == name, value).otherwise(grade)
    both = both.withColumn("grade", grade)
    s, d, t = F.col("stability").cast("double"), F.col("difficulty").cast("double"), F.col("days").cast("double")
    return both.select(
        "memory_id", "rating", "days", fsrs.next_stability(s, d, t, F.col("grade")).alias("stability"), fsrs.next_difficulty(d, F.col("grade")).alias("difficulty"), reviewed_at.alias("last_reviewed_at")
    )

"""Views of the driver's tables as the tables of the memory model, and the same views as SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palim.operators.ordered import dense_seq
from palim.schemas import CATEGORIES

#: The fixed present of all queries.
NOW = "2024-06-01 00:00:00"
GAP_MINUTES = (1, 29, 30, 31, 180, 181, 5)
#: Characters of a memory that make a query.
ASKED = 80


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_messages(spark: SparkSession, sf_dir: str, conversation: Column) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        conversation.cast("string").alias("conversation_id"), "event_id",
        F.when(F.col("user_id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat_ws(" ", "event_type", "props").alias("content"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return dense_seq(rows, "conversation_id", "event_id").drop("event_id")


def msg_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long conversations with many short gaps: by event type."""
    return _event_messages(spark, sf_dir, F.col("event_type"))


def msg_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft and hard gaps: by user, in 15 groups."""
    return _event_messages(spark, sf_dir, F.col("user_id") % 15)


def msg_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_messages(spark, sf_dir, F.col("user_id"))


def msg_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real turns, with times that plant gaps of exactly 30 and 180 minutes: the turn's gap is GAP_MINUTES[(conv_id + turn) % 7]."""
    gaps = F.array(*map(F.lit, GAP_MINUTES))
    offset = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("turn")), F.lit(0).cast("long"), lambda s, t: s + F.when(t == 0, 0).otherwise(F.get(gaps, ((F.col("conv_id") + t) % 7).cast("int"))))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        F.timestamp_micros(F.unix_micros(start) + F.col("conv_id") * 86_400_000_000 + offset * 60_000_000).alias("ts"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmentation state for each user's conversation."""
    last = msg_user(spark, sf_dir).groupBy("conversation_id").agg(F.max("seq").alias("last_message_seq"))
    k = F.col("conversation_id").cast("long")
    rows = last.withColumn("next_segment_start_seq", F.greatest(F.lit(0).cast("long"), F.col("last_message_seq") - k % 30)).withColumn("eof_identified", k % 4 == 0)
    active = k % 3 == 0
    return rows.withColumns(
        {
            "active_segment_start_seq": F.when(active, F.col("next_segment_start_seq")),
            "active_segment_end_seq": F.when(active, F.col("last_message_seq")),
            "active_since": F.when(active, F.timestamp_micros(F.unix_micros(now()) - (k % 5) * 40 * 60_000_000)),
        }
    )


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the texts of their documents. What is needed of a text's start is cut out before the join, and documents outside the range of the vectors' ids don't go into it, as they meet none."""
    vectors = table(spark, sf_dir, "embeddings")
    first, last = (vectors.select(f("vec_id")).scalar() for f in (F.min, F.max))
    title = F.substring("text", 1, 60)
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & F.col("doc_id").between(first, last))
    docs = docs.select("doc_id", "text", title.alias("title"), F.substring(F.concat(title, F.lit(" "), "text"), 1, ASKED).alias("titled_start"), F.substring("text", 1, ASKED).alias("start"))
    return vectors.join(docs, F.col("vec_id") == F.col("doc_id"))


def _shifted(days: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now()) - days * 86_400_000_000 - hours * 3_600_000_000)


def episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _memories(spark, sf_dir).select(
        k.alias("id"), F.col("label").cast("string").alias("conversation_id"), "title", F.col("text").alias("content"),
        F.concat("title", F.lit(" "), F.col("text")).alias("search_text"), F.col("titled_start").alias("search_start"), "embedding",
        (F.lit(0.5) + k % 37).cast("double").alias("stability"), (F.lit(1.0) + k % 9).cast("double").alias("difficulty"), ((k % 10) / 10).cast("double").alias("surprise"),
        F.when(k % 4 == 0, "low_info").otherwise("informative").alias("classification"), _shifted(k % 40, k % 24).alias("created_at"), _shifted(k % 50, k % 24).alias("last_reviewed_at"),
        F.when(k % 3 == 0, now()).alias("consolidated_at"),
    )


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    fact = F.col("text")
    return _memories(spark, sf_dir).select(
        k.alias("id"), F.col("label").cast("string").alias("conversation_id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 8 + 1).cast("int")).alias("category"),
        fact.alias("fact"), fact.alias("search_text"), F.col("start").alias("search_start"), F.array(F.concat(F.lit("e"), (k % 5).cast("string"))).alias("source_episodic_ids"),
        F.when(k % 11 == 0, now()).alias("invalid_at"), "embedding",
    )


def queries_for(memories: DataFrame) -> DataFrame:
    """One query for each conversation: the start of its first memory, with that memory's vector."""
    first = memories.groupBy("conversation_id").agg(F.min("id").alias("id"))
    return memories.join(first, ["conversation_id", "id"]).select(F.col("conversation_id").alias("query_id"), "conversation_id", F.col("search_start").alias("text"), "embedding")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review queue: every event asks for two memories of its kind."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("conversation_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("query"),
        F.array(F.col("event_id") % 400, F.col("user_id")).alias("memory_ids"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("consumed_at"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select((k % 450).alias("memory_id"), k.alias("place"), F.element_at(F.array(*map(F.lit, ("AGAIN", "hard", "x", "Easy", "good"))), (F.col("user_id") % 5 + 1).cast("int")).alias("rating"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model actions for episodes e0 to e(n/8): some untargeted, some on targets that several actions share."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(k / 8).alias("episode_id"), (k % 8).alias("place"), F.element_at(F.array(*map(F.lit, ("new", "reinforce", "invalidate", "update"))), (F.col("user_id") % 4 + 1).cast("int")).alias("kind"),
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" likes "), "props", F.lit(" "))).alias("fact"),
        F.when(k % 5 == 0, F.lit("unknown")).otherwise(F.element_at(F.array(*map(F.lit, (c.upper() for c in CATEGORIES))), (k % 8 + 1).cast("int"))).alias("category"),
        F.when(k % 6 == 0, F.lit(" ")).otherwise((F.col("user_id") % 50 * 12 + k % 3).cast("string")).alias("target_fact_id"), ((k % 30) / 20).cast("double").alias("confidence"),
    )


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a gold answer and the assistant's next turn as the prediction."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return user.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", (F.col("conv_id") % 10).cast("string").alias("sample_id"), (F.col("conv_id") % 5 + 1).cast("int").alias("category"), F.col("gold"), F.col("prediction"),
        F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question"),
    )


def _events_sql(conversation: str) -> str:
    return (
        f"SELECT CAST({conversation} AS VARCHAR) AS conversation_id, row_number() OVER (PARTITION BY {conversation} ORDER BY event_id) - 1 AS seq, "
        "CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, concat_ws(' ', event_type, props) AS content, CAST(ts AS TIMESTAMP) AS ts FROM events"
    )


_GAP_LIST = "[" + ", ".join(map(str, GAP_MINUTES)) + "]"
_CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_UPPER_LIST = _CATEGORY_LIST.upper()

#: The views above for DuckDB, by name.
SQL = {
    "msg_dense": _events_sql("event_type"),
    "msg_hard": _events_sql("user_id % 15"),
    "msg_user": _events_sql("user_id"),
    "msg_conv": f"""SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS seq, role, text AS content,
        TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(CAST(coalesce(list_sum(list_transform(range(1, turn + 1), lambda t: {_GAP_LIST}[1 + (conv_id + t) % 7])), 0) AS BIGINT)) AS ts FROM conversations""",
    "states": f"""SELECT *, CASE WHEN k % 3 = 0 THEN next_segment_start_seq END AS active_segment_start_seq, CASE WHEN k % 3 = 0 THEN last_message_seq END AS active_segment_end_seq,
        CASE WHEN k % 3 = 0 THEN TIMESTAMP '{NOW}' - to_minutes(CAST((k % 5) * 40 AS BIGINT)) END AS active_since
        FROM (SELECT *, greatest(0, last_message_seq - k % 30) AS next_segment_start_seq, k % 4 = 0 AS eof_identified
        FROM (SELECT conversation_id, CAST(conversation_id AS BIGINT) AS k, max(seq) AS last_message_seq FROM msg_user GROUP BY 1, 2))""",
    "episodic": f"""SELECT doc_id AS id, CAST(label AS VARCHAR) AS conversation_id, left(text, 60) AS title, text AS content, left(text, 60) || ' ' || text AS search_text, embedding,
        CAST(0.5 + doc_id % 37 AS DOUBLE) AS stability, CAST(1.0 + doc_id % 9 AS DOUBLE) AS difficulty, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS surprise, CASE WHEN doc_id % 4 = 0 THEN 'low_info' ELSE 'informative' END AS classification,
        TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 40 AS INTEGER)) - to_hours(doc_id % 24) AS created_at, TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 50 AS INTEGER)) - to_hours(doc_id % 24) AS last_reviewed_at,
        CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '{NOW}' END AS consolidated_at FROM embeddings JOIN documents ON vec_id = doc_id WHERE text IS NOT NULL""",
    "semantic": f"""SELECT doc_id AS id, CAST(label AS VARCHAR) AS conversation_id, {_CATEGORY_LIST}[1 + doc_id % 8] AS category, text AS fact, text AS search_text, ['e' || (doc_id % 5)] AS source_episodic_ids,
        CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '{NOW}' END AS invalid_at, embedding FROM embeddings JOIN documents ON vec_id = doc_id WHERE text IS NOT NULL""",
    "pending": """SELECT event_id AS id, event_type AS conversation_id, concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS query, [event_id % 400, user_id] AS memory_ids,
        CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS TIMESTAMP) END AS consumed_at FROM events""",
    "ratings": "SELECT event_id % 450 AS memory_id, event_id AS place, ['AGAIN', 'hard', 'x', 'Easy', 'good'][1 + user_id % 5] AS rating FROM events",
    "actions": f"""SELECT event_id // 8 AS episode_id, event_id % 8 AS place, ['new', 'reinforce', 'invalidate', 'update'][1 + user_id % 4] AS kind, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE ' likes ' || props || ' ' END AS fact,
        CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE {_UPPER_LIST}[1 + event_id % 8] END AS category, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE CAST(user_id % 50 * 12 + event_id % 3 AS VARCHAR) END AS target_fact_id,
        CAST((event_id % 30) / 20.0 AS DOUBLE) AS confidence FROM events""",
    "qa": """SELECT u.conv_id, u.turn, CAST(u.conv_id % 10 AS VARCHAR) AS sample_id, CAST(u.conv_id % 5 + 1 AS INTEGER) AS category, u.text AS gold, a.text AS prediction, 'q' || u.turn AS question
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
}
_NEEDS = {"states": ("msg_user",)}


def sql(body: str, *views: str, recursive: bool = False, once: tuple = (), **more: str) -> str:
    """A statement over named views: theirs and the given common tables in front of the body; those in `once` are made once, not for each use."""
    named: dict[str, str] = {}
    for v in views:
        for need in (*_NEEDS.get(v, ()), v):
            named[need] = SQL[need]
    named |= more
    head = ", ".join(f"{k} AS {'MATERIALIZED ' if k in once else ''}({v})" for k, v in named.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if named else body

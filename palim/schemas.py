"""Table schemas and the fixed values of the memory model."""

from pyspark.sql import types as T

# Fixed values of the model: segmentation, retrieval, consolidation, review.
TRIGGER_MESSAGES = 20
SOFT_GAP_MINUTES = 30  # inclusive
HARD_GAP_MINUTES = 180  # exclusive
LEASE_MINUTES = 120  # a lease is stale after more than this
CLASSIFY_MAX = 4
SPLIT_ABOVE = 20
MERGE_BELOW = 30
LEG_CANDIDATES = 100
EPISODIC_FINAL = 100
RRF_K = 30
EPISODIC_LIMIT, SEMANTIC_LIMIT, RECENT_LIMIT = 10, 20, 10
DUPLICATE_SIMILARITY = 0.95  # exclusive
SIMILAR_FACTS = 5
PREDICT_FACTS, PREDICT_GUIDELINES, ACTION_FACTS = 10, 3, 20
KEY_MOMENT = 0.7
EMBEDDING_DIM = 1024
MAX_DAYS = 36500

CATEGORIES = ("identity", "preference", "interest", "personality", "relationship", "experience", "goal", "guideline")
ACTION_PRIORITY = {"new": 0, "reinforce": 1, "invalidate": 2, "update": 3}
QUESTION_TYPES = ("single-session-user", "single-session-assistant", "single-session-preference", "multi-session", "temporal-reasoning", "knowledge-update")
QA_CATEGORIES = (1, 2, 3, 4, 5)

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("timestamp", T.TimestampType())]
)

CONVERSATION_MESSAGE = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
    ]
)

SEGMENTATION_STATE = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("last_message_seq", T.LongType(), False),
        T.StructField("eof_identified", T.BooleanType(), False),
        T.StructField("next_segment_start_seq", T.LongType(), False),
        T.StructField("active_segment_start_seq", T.LongType()),
        T.StructField("active_segment_end_seq", T.LongType()),
        T.StructField("active_since", T.TimestampType()),
    ]
)

EPISODE_SPAN = T.StructType(
    [
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("start_seq", T.LongType(), False),
        T.StructField("end_seq", T.LongType(), False),
        T.StructField("classification", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
    ]
)

PENDING_REVIEW = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("memory_ids", T.ArrayType(T.StringType()), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("consumed_at", T.TimestampType()),
    ]
)

EPISODIC_MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("messages", T.ArrayType(MESSAGE), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("stability", T.FloatType(), False),
        T.StructField("difficulty", T.FloatType(), False),
        T.StructField("surprise", T.FloatType(), False),
        T.StructField("classification", T.StringType()),
        T.StructField("start_at", T.TimestampType(), False),
        T.StructField("end_at", T.TimestampType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("last_reviewed_at", T.TimestampType(), False),
        T.StructField("consolidated_at", T.TimestampType()),
    ]
)

SEMANTIC_MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("fact", T.StringType(), False),
        T.StructField("source_episodic_ids", T.ArrayType(T.StringType()), False),
        T.StructField("valid_at", T.TimestampType(), False),
        T.StructField("invalid_at", T.TimestampType()),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

QA_RESULT = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("question", T.StringType()),
        T.StructField("gold_answer", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("context_retrieved", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("set_f1_score", T.DoubleType()),
        T.StructField("judge_score", T.DoubleType()),
    ]
)

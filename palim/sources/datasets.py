"""Readers of question-answering datasets, and of key-to-vector caches."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palim.schemas import QA_CATEGORIES, QUESTION_TYPES
from palim.sources.json_array import json_array

MAX_SESSIONS = 100
TURN_MINUTES = 1

_TURN = "struct<speaker:string,dia_id:string,text:string,blip_caption:string,search_query:string,query:string>"
_QA = "array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, conversation (map of JSON texts) and qa of a dialogue dataset: a JSON array of samples.

    Answers may be numbers or texts. Of category 5, the adversarial answer stands in for a missing one. A category out of range is an error.
    """
    schema = f"sample_id string, conversation map<string,string>, qa {_QA}"
    samples = json_array(spark, path, schema)
    answer = lambda q: F.when(q["category"] == 5, F.coalesce(q["answer"], q["adversarial_answer"])).otherwise(q["answer"])
    checked = F.transform(
        "qa",
        lambda q: F.struct(
            q["question"].alias("question"), answer(q).alias("answer"),
            F.when(q["category"].isin(*QA_CATEGORIES), q["category"]).otherwise(F.raise_error(F.lit("unknown category")).cast("int")).alias("category"), q["evidence"].alias("evidence"),
        ),
    )
    return samples.withColumn("qa", checked)


def questions(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.posexplode("qa").alias("place", "q")).select("sample_id", "place", "q.*")


def session_date(text):
    """`1:56 pm on 8 May, 2023` as a UTC timestamp; null if it reads otherwise."""
    pattern = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)\s+on\s+(\d{1,2})\s+(\w+),\s+(\d{4})$"
    part = [F.regexp_extract(text, pattern, i) for i in range(7)]
    month = F.array_position(F.array(*map(F.lit, ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))), F.lower(part[5]))
    hour = F.expr("0") + F.pmod(F.try_to_number(part[1], F.lit("99")).cast("int"), F.lit(12)) + F.when(F.lower(part[3]) == "pm", 12).otherwise(0)
    made = F.make_timestamp(F.try_to_number(part[6], F.lit("9999")).cast("int"), month.cast("int"), F.try_to_number(part[4], F.lit("99")).cast("int"), hour.cast("int"), F.try_to_number(part[2], F.lit("99")).cast("int"), F.lit(0), F.lit("UTC"))
    return F.when((part[0] != "") & (month > 0), made)


def sessions(samples: DataFrame) -> DataFrame:
    """sample_id, n, date, turns: sessions 1, 2, ... up to the first that is missing (100 at most)."""
    entries = samples.select("sample_id", F.col("conversation").alias("c"), F.explode(F.map_keys("conversation")).alias("k"))
    entries = entries.withColumn("n", F.when(F.col("k").rlike(r"^session_\d+$"), F.substring_index("k", "_", -1).cast("int"))).filter(F.col("n").between(1, MAX_SESSIONS))
    entries = entries.withColumn("turns", F.from_json(F.col("c")[F.col("k")], f"array<{_TURN}>")).filter("turns IS NOT NULL")
    order = Window.partitionBy("sample_id").orderBy("n")
    entries = entries.withColumn("place", F.row_number().over(order)).filter("place = n")
    raw = F.col("c")[F.concat(F.lit("session_"), F.col("n").cast("string"), F.lit("_date_time"))]
    return entries.select("sample_id", "n", raw.alias("date_text"), session_date(raw).alias("date"), "turns")


def dialogue_messages(samples: DataFrame) -> DataFrame:
    """sample_id, session, turn, role, content, ts: blank turns are skipped but keep their minute; captions follow the text."""
    rows = sessions(samples).select("sample_id", F.col("n").alias("session"), "date", F.posexplode("turns").alias("turn", "t"))
    rows = rows.filter(F.trim(F.coalesce("t.text", F.lit(""))) != "")
    caption, query = F.trim("t.blip_caption"), F.trim(F.coalesce("t.query", "t.search_query"))
    image = F.when(F.coalesce(caption, F.lit("")) != "", F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("[Image: "), caption, F.lit("; Image Retrieval Keywords: "), query, F.lit("]"))).otherwise(F.concat(F.lit("[Image: "), caption, F.lit("]"))))
    role = F.when(F.trim(F.coalesce("t.speaker", F.lit(""))) == "", "User").otherwise(F.trim("t.speaker"))
    return rows.select("sample_id", "session", "turn", role.alias("role"), F.concat_ws(" ", F.trim("t.text"), image).alias("content"), (F.col("date") + F.make_dt_interval(mins=F.col("turn") * TURN_MINUTES)).alias("ts"))


def full_context(samples: DataFrame) -> DataFrame:
    """sample_id and its whole conversation as one text."""
    said = lambda t: F.concat(t["speaker"], F.lit(' said, "'), t["text"], F.lit('"'), F.when(F.coalesce(t["blip_caption"], F.lit("")) != "", F.concat(F.lit("\nand shared "), t["blip_caption"], F.lit("."))).otherwise(""), F.when(F.coalesce(t["search_query"], F.lit("")) != "", F.concat(F.lit("\nSearch query: "), t["search_query"], F.lit("."))).otherwise(""))
    body = F.concat(F.lit("DATE: "), F.coalesce("date_text", F.lit("unknown date")), F.lit("\nCONVERSATION:\n"), F.array_join(F.transform("turns", said), "\n"))
    parts = sessions(samples).select("sample_id", F.struct("n", F.rtrim(body).alias("body")).alias("s")).groupBy("sample_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return parts.select("sample_id", F.concat(F.lit("Below is a conversation between two people over multiple days.\n\n"), F.array_join(F.transform("s", lambda s: s["body"]), "\n\n")).alias("context"))


_HAYSTACK = T.StructType(
    [
        T.StructField("question_id", T.StringType()), T.StructField("question_type", T.StringType()), T.StructField("question", T.StringType()), T.StructField("question_date", T.StringType()), T.StructField("answer", T.StringType()),
        T.StructField("answer_session_ids", T.ArrayType(T.StringType())), T.StructField("haystack_dates", T.ArrayType(T.StringType())), T.StructField("haystack_session_ids", T.ArrayType(T.StringType())),
        T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])))),
    ]
)


def haystacks(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a haystack dataset; an unknown question type is an error."""
    rows = json_array(spark, path, _HAYSTACK)
    known = F.when(F.col("question_type").isin(*QUESTION_TYPES), F.col("question_type")).otherwise(F.raise_error(F.lit("unknown question type")).cast("string"))
    return rows.withColumn("question_type", known)


def haystack_messages(samples: DataFrame) -> DataFrame:
    """question_id, session, turn, role, content, ts: sessions meet their dates by place; blank turns are skipped but keep their minute."""
    zipped = samples.select("question_id", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates")).alias("session", "s"))
    plain = F.trim(F.regexp_replace("s.haystack_dates", r"\s*\(\w+\)", ""))  # the day of the week says nothing new
    date = F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(plain))
    rows = zipped.select("question_id", "session", date.alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t")).filter(F.trim("t.content") != "")
    return rows.select("question_id", "session", "turn", "t.role", "t.content", (F.col("date") + F.make_dt_interval(mins=F.col("turn") * TURN_MINUTES)).alias("ts"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, embedding of a JSON-lines cache: blank lines don't count, of a key's rows the last holds (by the name of the file, then the place in it); a missing file is an empty cache."""
    schema = "key string, embedding array<float>"
    try:
        lines = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("__at")).filter("key IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return lines.groupBy("key").agg(F.max_by("embedding", "__at").alias("embedding"))


def append_cache(rows: DataFrame, path: str) -> None:
    """Adds rows in files whose names come after those that are there."""
    rows.select("key", "embedding").write.json(f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex}")

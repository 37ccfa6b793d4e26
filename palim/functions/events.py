"""Events tagged by their type, flattened into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.functions.text import event_role, event_text

_MESSAGE = "struct<type:string,role:string,content:string>"


def messages(rows: DataFrame, json: str = "event") -> DataFrame:
    """Rows whose JSON is of type `message`, with its role and content; other types have no text and are left out."""
    parsed = rows.withColumn("__e", F.from_json(json, _MESSAGE)).filter("__e.type = 'message'")
    return parsed.withColumn("role", event_role(F.col("__e.role"))).withColumn("content", F.col("__e.content")).drop("__e")


def encode(role: Column, content: Column) -> Column:
    return F.to_json(F.struct(F.lit("message").alias("type"), role.alias("role"), content.alias("content")))


def text(ts: Column | None = None) -> Column:
    return event_text(F.col("role"), F.col("content"), ts)

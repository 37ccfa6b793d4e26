"""Reading large JSON arrays in parallel.

Spark's text reader cuts a file wherever it likes at a closing brace; what lies between two braces is a row. Whether a row begins inside a string, and how deep it
lies, follows from sums over the rows before it: of quotes (but for escaped ones), then of brackets outside strings. Where the depth comes back to the
array's own, an object ends. Sums are made by ranges of rows, so that no file fills a task, and the objects are put together again from their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palim.operators.ordered import numbered_in_parts, running_sum
from palim.sources.store import stored

END = "}"


def _depth(text: Column) -> Column:
    """Brackets opened less those closed."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _pieces(plain: Column, inside: bool) -> Column:
    """What of a text without escapes lies outside strings, if it begins inside one or not."""
    return F.array_join(F.filter(F.split(plain, '"'), lambda _, i: i % 2 == int(inside)), " ")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0, in order, with gaps) and value (JSON text) of each object in the arrays of JSON objects that the files under `path` hold.

    A file may hold several arrays one after another. Objects must be JSON; other values of an array are left out.
    """
    rows = spark.read.option("lineSep", END).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    plain = F.regexp_replace("value", r"\\.", "")
    known = stored(rows.select("file", "block", "at", "value", (F.length(plain) - F.length(F.replace(plain, F.lit('"')))).alias("quotes"), _depth(_pieces(plain, False)).alias("depth_out"), _depth(_pieces(plain, True)).alias("depth_in")))
    narrow = stored(numbered_in_parts(known.drop("value"), "file", "block", ["at"], "seq"))
    quoted = running_sum(narrow, "file", "seq", F.col("quotes"), "quotes_sum")
    inside = F.pmod(F.col("quotes_sum") - F.col("quotes"), F.lit(2)) == 1
    closes = F.pmod(F.col("quotes_sum"), F.lit(2)) == 0  # the brace behind the row counts if no string is open there
    turn = F.when(inside, F.col("depth_in")).otherwise(F.col("depth_out")) - F.when(closes, 1).otherwise(0)
    deep = running_sum(quoted.withColumn("closes", closes), "file", "seq", turn, "depth")
    ends = F.when(F.col("closes") & (F.col("depth") == 1), 1).otherwise(0)
    numbered = running_sum(deep.withColumn("ends", ends), "file", "seq", F.col("ends"), "ended").withColumn("number", F.col("ended") - F.col("ends"))
    whole = numbered.select("file", "at", "seq", "number", "ends").join(known.select("file", "at", "value"), ["file", "at"])
    parts = whole.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("rows"), F.max("ends").alias("complete")).filter("complete = 1")
    # Null for what is no object, so that a parser put before the filter has nothing to reject.
    value = F.when(F.col("complete") == 1, F.concat(F.array_join(F.col("rows.value"), END), F.lit(END)))
    return parts.select("file", "number", F.regexp_replace(value, r"^[\s,\[\]]+", "").alias("value"))


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects as rows of a schema; what doesn't fit it is an error."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return json_objects(spark, path).select(parsed.alias("v")).select("v.*")


def write_json_arrays(rows: DataFrame, column: str, path: str) -> None:
    """Writes JSON texts as files that hold one array each, a file for each partition: nothing is gathered."""

    def run(batches):
        import pyarrow as pa

        lead = "["
        for b in batches:
            for value in b.column(column):
                yield pa.RecordBatch.from_arrays([pa.array([lead + value.as_py()])], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    rows.select(column).mapInArrow(run, "value string").write.text(path)

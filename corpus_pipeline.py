"""A training-data pipeline: each stage works on all that the stage before it kept.

Every stage but the last gives documents with the columns it got; the last gives their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palim.llm import decontamination, near_dedup, sentencepiece_codec, substring_dedup, toxicity
from palim.llm.common import discard, materialise
from palim.shipping import ship

#: Near-duplicates are judged on sets of five-word shingles, and linked from this similarity on.
SHINGLE, SIMILARITY = 5, 0.8


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    return changed.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema.fields])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity reaches the threshold go."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays. Rows with a null id stay. Of rows with one id and different texts, only those go whose own text is in a group with a lesser id."""
    ship(spark)
    found = near_dedup.similar_groups(docs, SHINGLE, SIMILARITY)
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__hash"]), "left_anti")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start in an earlier document go; documents of which nothing is left go with them.

    A text that loses nothing stays as it is; n_chars, where there is one, follows the text.
    """
    ship(spark)
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    inner = {c: f"__extra{i}" for i, c in enumerate(extra)}
    kept = substring_dedup.remove_repeats(docs.withColumnsRenamed(inner), (*inner.values(), "text"))
    kept = kept.filter("n_removed = 0 OR n_words > n_removed").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    out = kept.drop("n_words", "kept").withColumnsRenamed({v: k for k, v in inner.items()})
    if "n_chars" in extra:
        out = out.withColumn("n_chars", F.when(kept["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars")))
    return _like(docs, out)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark question, as it is or re-parameterised, go. Each row is judged by its own text, also with a null or a repeated id."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and its pieces."""
    ship(spark)
    return sentencepiece_codec.encode(docs.select("doc_id", "text"), sentencepiece_codec.model_path(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Trained scores, fingerprints and tokens aren't expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, each written and read again."""
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            before, docs = read, materialise(docs)
            discard(before)
            read = docs
    return docs

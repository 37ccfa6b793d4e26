"""Keyword search over blocks of postings with their largest score each.

The memories of a conversation are numbered and lie in blocks of BLOCK numbers. A row of the index is one term in one block: the numbers
inside the block, what the term gives each memory, and the most it gives any. A query first adds up what its terms can give at most in each block; its best
blocks are scored, and only blocks that can still beat the last of the best so far are read at all. Results are those of a full reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palim.operators.ordered import dense_seq
from palim.operators.retrieval import B, K1, corpus_stats, postings, query_terms
from palim.sources.store import stored

BLOCK = 64
#: Blocks that a query scores at first, beside those that its limit fills.
FIRST = 2
#: What rounding may hide in a sum.
SLACK = 1e-9


def build(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks (conversation_id, term, block, top, places, parts) and the memories' numbers (conversation_id, block, place, id), both stored. memories: id, conversation_id, search_text.

    Scores are BM25 over all memories, as retrieval.bm25 has them. A null conversation has no index.
    """
    known = memories.filter("conversation_id IS NOT NULL")
    numbers = stored(dense_seq(known.select("conversation_id", "id"), "conversation_id", "id").select("conversation_id", F.floor(F.col("seq") / BLOCK).alias("block"), F.pmod("seq", F.lit(BLOCK)).cast("byte").alias("place"), "id"))
    index = stored(postings(memories))
    frequencies = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(corpus_stats(memories))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = index.join(frequencies, "term").crossJoin(stats).select("term", "id", "conversation_id", part.alias("part")).join(numbers, ["conversation_id", "id"])
    rows = F.array_sort(F.collect_list(F.struct("place", "part")))  # BLOCK at most
    blocks = scored.groupBy("conversation_id", "term", "block").agg(F.max("part").alias("top"), rows.alias("rows")).select("conversation_id", "term", "block", "top", F.col("rows.place").alias("places"), F.col("rows.part").alias("parts"))
    return stored(blocks.repartition("conversation_id", "term").sortWithinPartitions("conversation_id", "term", "block")), numbers


def _bounds(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, conversation_id, block, most: reads no postings."""
    tops = blocks.select("conversation_id", "term", "block", "top")
    return tops.join(terms, ["conversation_id", "term"]).groupBy("query_id", "conversation_id", "block").agg(F.sum("top").alias("most"))


def _scores(blocks: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, conversation_id, block, place, score of the blocks in wanted (query_id, conversation_id, block)."""
    asked = wanted.join(terms, ["query_id", "conversation_id"]).join(blocks, ["conversation_id", "term", "block"])
    rows = asked.select("query_id", "conversation_id", "block", F.explode(F.arrays_zip("places", "parts")).alias("x"))
    return rows.groupBy("query_id", "conversation_id", "block", F.col("x.places").alias("place")).agg(F.sum("x.parts").alias("score"))


def best(blocks: DataFrame, numbers: DataFrame, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """query_id, id, score, r: the `limit` best memories of each query's conversation, equal scores by the lesser id; and query_id, conversation_id, block: the blocks that were read.

    queries: query_id, conversation_id, text. Queries without a known term have no rows.
    """
    terms = stored(query_terms(queries))
    bounds = stored(_bounds(blocks, terms))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    first = stored(bounds.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= -(-limit // BLOCK) + FIRST).select("query_id", "conversation_id", "block"))
    begun = stored(_scores(blocks, terms, first))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floors = begun.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") == limit).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(first, ["query_id", "conversation_id", "block"], "left_anti").join(floors, "query_id", "left")
    more = stored(rest.filter(F.col("floor").isNull() | (F.col("most") > F.col("floor") - SLACK)).select("query_id", "conversation_id", "block"))
    scores = begun.unionByName(_scores(blocks, terms, more))
    # Only the best go on to their ids; what rounding to 9 digits can't tell from the last stays until ids decide.
    near = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)))
    kept = scores.withColumn("n", F.rank().over(near)).filter(F.col("n") <= limit)
    named = kept.join(numbers, ["conversation_id", "block", "place"])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return named.withColumn("r", F.row_number().over(order).cast("long")).filter(F.col("r") <= limit).select("query_id", "id", "score", "r"), first.unionByName(more)


def touched(blocks: DataFrame, queries: DataFrame, read: DataFrame) -> DataFrame:
    """query_id, read, postings: postings of the query's terms that were read, and all."""
    terms = query_terms(queries)
    sizes = blocks.select("conversation_id", "term", "block", F.size("places").alias("size")).join(terms, ["conversation_id", "term"])
    marked = sizes.join(read.withColumn("seen", F.lit(1)), ["query_id", "conversation_id", "block"], "left")
    return marked.groupBy("query_id").agg(F.sum(F.when(F.col("seen") == 1, F.col("size")).otherwise(0)).alias("read"), F.sum("size").alias("postings"))

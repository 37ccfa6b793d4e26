"""Hybrid retrieval for many queries at once: a BM25 leg and a vector leg, fused by reciprocal ranks.

Memories have id, conversation_id, search_text, embedding; queries have query_id, conversation_id, text, embedding.
Statistics of terms are those of the whole index. Ranks are within a query; ties go to the lesser id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim.functions import fsrs
from palim.functions.text import tokens
from palim.operators.cells import nearest
from palim.operators.similarity_join import above
from palim.schemas import EPISODIC_FINAL, LEG_CANDIDATES, MAX_DAYS, RRF_K
from palim.sources.store import stored

K1, B = 1.2, 0.75
#: Distinct terms of queries up to which they are broadcast; beyond, the join shuffles both sides.
BROADCAST_TERMS = 100_000


def postings(memories: DataFrame) -> DataFrame:
    """term, id, conversation_id, tf and dl: the inverted index."""
    words = memories.select("id", "conversation_id", tokens(F.col("search_text")).alias("w")).withColumn("dl", F.size("w").cast("long"))
    return words.select("id", "conversation_id", "dl", F.explode("w").alias("term")).groupBy("term", "id", "conversation_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(memories: DataFrame) -> DataFrame:
    return memories.select(F.size(tokens(F.col("search_text"))).cast("double").alias("dl")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "conversation_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def wanted_postings(memories: DataFrame, terms: DataFrame) -> tuple[DataFrame, bool]:
    """The postings of the terms that queries have, and for each memory a row without a term; whether the distinct terms are few.

    The postings are stored: other terms are dropped before anything is counted or dealt out, and the memories' texts are read once, for lengths too.
    """
    words = memories.select("id", "conversation_id", tokens(F.col("search_text")).alias("w")).withColumn("dl", F.size("w").cast("long"))
    none = F.array(F.lit(None).cast("string"))
    exploded = words.select("id", "conversation_id", "dl", F.explode(F.concat(none, F.coalesce("w", F.array().cast("array<string>")))).alias("term"))
    wanted = terms.select(F.col("term").alias("__wanted")).distinct()
    known = wanted.limit(BROADCAST_TERMS + 1).collect()
    few = len(known) <= BROADCAST_TERMS
    if few:
        listed = F.broadcast(memories.sparkSession.createDataFrame([*known, (None,)], "__wanted string"))
        kept = exploded.join(listed, F.col("term").eqNullSafe(F.col("__wanted")), "left_semi")
    else:
        kept = exploded.filter("term IS NOT NULL").join(wanted, F.col("term") == F.col("__wanted"), "left_semi").unionByName(exploded.filter("term IS NULL"))
    return stored(kept.groupBy("term", "id", "conversation_id", "dl").agg(F.count(F.lit(1)).alias("tf"))), few


def bm25(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score for memories that share a term with the query."""
    terms = stored(query_terms(queries))
    rows, few = wanted_postings(memories, terms)
    index = rows.filter("term IS NOT NULL")
    frequencies = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Of each memory one row without a term: one row in all.
    stats = F.broadcast(rows.filter("term IS NULL").agg(F.sum("tf").cast("double").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl")))
    met = index.join(terms, ["term", "conversation_id"]).join(F.broadcast(frequencies) if few else frequencies, "term").crossJoin(stats)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, limit: int = LEG_CANDIDATES) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("r", F.row_number().over(order).cast("long")).filter(F.col("r") <= limit)


def vector_scores(memories: DataFrame, queries: DataFrame, limit: int = LEG_CANDIDATES) -> DataFrame:
    """query_id, id, score: the best `limit` memories of the query's conversation by inner product, and some more. A conversation of any size is dealt out in cells."""
    probes = queries.select("conversation_id", F.col("query_id").alias("probe"), F.lit(None).alias("exclude"), F.col("embedding").alias("vector"))
    members = memories.select("conversation_id", F.col("id").alias("member"), F.col("embedding").alias("vector"))
    return nearest(probes, members, "conversation_id", limit).select(F.col("probe").alias("query_id"), F.col("member").alias("id"), "score")


def fused(memories: DataFrame, queries: DataFrame, candidates: int = LEG_CANDIDATES) -> DataFrame:
    """query_id, id, rrf: the sum of 1 / (30 + rank) over the legs that found it. Only ids and scores are shuffled. The queries are made once."""
    queries = stored(queries)
    legs = ranked(bm25(memories, queries), candidates).select("query_id", "id", "r").unionByName(ranked(vector_scores(memories, queries, candidates), candidates).select("query_id", "id", "r"))
    return legs.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("r"))).alias("rrf"))


def _top(scored: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), F.desc(F.round(tie, 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between, within 0 and 36500."""
    days = ((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(MAX_DAYS), days))


def episodic(memories: DataFrame, queries: DataFrame, now: Column, limit: int) -> DataFrame:
    """The best episodes of each query: fused score times the chance of recall now. limit isn't bounded; 0 gives none."""
    best = _top(fused(memories, queries), "rrf", "rrf", EPISODIC_FINAL).drop("rank")
    state = memories.select("id", "stability", "last_reviewed_at")
    recall = fsrs.retrievability(F.col("stability").cast("double"), whole_days(now, F.col("last_reviewed_at")).cast("double"))
    scored = best.join(state, "id").withColumn("retrievability", recall).withColumn("score", F.col("rrf") * F.col("retrievability"))
    return _top(scored, "score", "rrf", limit).select("query_id", "rank", "id", "rrf", "retrievability", "score")


def semantic_limit(value: int) -> int:
    return value if 0 < value <= 1000 else 100


def recent_limit(value: int | None) -> int:
    return min(100, max(1, 10 if value is None else value))


def semantic(facts: DataFrame, queries: DataFrame, limit: int, category: str | None = None) -> DataFrame:
    """The best active facts of each query; both legs see the category filter, where one is given."""
    active = facts.filter("invalid_at IS NULL")
    if category is not None:
        active = active.filter(F.col("category") == category)
    # Term statistics are the whole table's, as an index has them.
    return _top(_fused_over(active, facts, queries), "rrf", "rrf", semantic_limit(limit)).select("query_id", "rank", "id", F.col("rrf").alias("score"))


def _fused_over(active: DataFrame, table: DataFrame, queries: DataFrame) -> DataFrame:
    queries = stored(queries)
    keyword = bm25(table, queries).join(active.select("id"), "id", "left_semi")
    legs = ranked(keyword).select("query_id", "id", "r").unionByName(ranked(vector_scores(active, queries)).select("query_id", "id", "r"))
    return legs.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("r"))).alias("rrf"))


def recent(memories: DataFrame, now: Column, days: int | None, limit: int | None) -> DataFrame:
    """Newest first, of all or the last so many days."""
    rows = memories if days is None else memories.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return rows.orderBy(F.desc("created_at"), "id").limit(recent_limit(limit))


def similar_facts(probes: DataFrame, facts: DataFrame, threshold: float, limit: int = 5, work=None) -> DataFrame:
    """probes: probe_id, conversation_id, embedding, exclude_id (or null). Up to `limit` active facts of the conversation above the threshold. work: an accumulator of multiplications."""
    members = facts.filter("invalid_at IS NULL").select("conversation_id", F.col("id").alias("member"), F.col("embedding").alias("vector"))
    asked = probes.select("conversation_id", F.col("probe_id").alias("probe"), F.col("exclude_id").alias("exclude"), F.col("embedding").alias("vector"))
    found = above(asked, members, "conversation_id", limit, threshold, work)
    scored = found.select(F.col("probe").alias("probe_id"), F.col("member").alias("id"), F.col("score").alias("similarity"))
    order = Window.partitionBy("probe_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).select("probe_id", "id", "similarity", "rank")

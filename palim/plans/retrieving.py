"""Queries on memories: hybrid retrieval, recent memories, review states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.functions import fsrs
from palim.functions.text import search_text, tokens
from palim.functions.vector import normalize
from palim.operators import block_max, consolidation, retrieval, review, vector_index
from palim.sources import adapters as ad
from palim.sources.adapters import NOW, sql

LIMIT = 10
REDUCED_DIM = 32


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    memories = ad.episodic(spark, sf_dir)
    return memories, ad.queries_for(memories)


def hybrid_episodic(spark, sf_dir) -> DataFrame:
    out = retrieval.episodic(*_asked(spark, sf_dir), ad.now(), LIMIT)
    return out.select("query_id", "rank", "id", *[F.round(c, 6).alias(c) for c in ("rrf", "retrievability", "score")])


def _facts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    facts = ad.semantic(spark, sf_dir)
    return facts, ad.queries_for(facts)


def hybrid_semantic(spark, sf_dir) -> DataFrame:
    return retrieval.semantic(*_facts(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


def hybrid_semantic_category(spark, sf_dir) -> DataFrame:
    return retrieval.semantic(*_facts(spark, sf_dir), 20, "guideline").withColumn("score", F.round("score", 6))


def bm25_rank(spark, sf_dir) -> DataFrame:
    return retrieval.ranked(retrieval.bm25(*_asked(spark, sf_dir))).select("query_id", "id", F.round("score", 6).alias("score"), "r")


def vector_rank(spark, sf_dir) -> DataFrame:
    return retrieval.ranked(retrieval.vector_scores(*_asked(spark, sf_dir))).select("query_id", "id", F.round("score", 6).alias("score"), "r")


def rrf_fuse(spark, sf_dir) -> DataFrame:
    return retrieval.fused(*_asked(spark, sf_dir)).withColumn("rrf", F.round("rrf", 6))


def search_text_(spark, sf_dir) -> DataFrame:
    return ad.episodic(spark, sf_dir).select("id", search_text(F.when(F.col("id") % 3 > 0, F.col("title")), F.col("content")).alias("search_text"))


def tokenize(spark, sf_dir) -> DataFrame:
    rows = ad.episodic(spark, sf_dir).select("id", F.posexplode(tokens(F.col("search_text"))).alias("place", "term"))
    return rows.select("id", F.col("place").cast("long"), "term")


def postings(spark, sf_dir) -> DataFrame:
    return retrieval.postings(ad.episodic(spark, sf_dir)).select("term", "id", "tf", "dl")


def term_stats(spark, sf_dir) -> DataFrame:
    return retrieval.term_stats(retrieval.postings(ad.episodic(spark, sf_dir)))


def corpus_stats(spark, sf_dir) -> DataFrame:
    return retrieval.corpus_stats(ad.episodic(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), F.round("avgdl", 6).alias("avgdl"))


def embedding_normalize(spark, sf_dir) -> DataFrame:
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(normalize(F.col("embedding"), REDUCED_DIM)).alias("place", "value"))
    return rows.select("vec_id", F.col("place").cast("long"), F.round("value", 6).alias("value"))


def recent_memories(spark, sf_dir) -> DataFrame:
    return retrieval.recent(ad.episodic(spark, sf_dir), ad.now(), 20, 50).select("id", "conversation_id", F.unix_micros("created_at").alias("created_us"))


def fsrs_retrievability(spark, sf_dir) -> DataFrame:
    days = retrieval.whole_days(ad.now(), F.col("last_reviewed_at"))
    return ad.episodic(spark, sf_dir).select("id", days.alias("days"), F.round(fsrs.retrievability(F.col("stability"), days.cast("double")), 6).alias("retrievability"))


def fsrs_init(spark, sf_dir) -> DataFrame:
    return ad.episodic(spark, sf_dir).select("id", F.round(F.lit(fsrs.INITIAL_STABILITY), 6).alias("stability"), F.round(F.lit(fsrs.INITIAL_DIFFICULTY), 6).alias("difficulty"))


def fsrs_next_states(spark, sf_dir) -> DataFrame:
    grades = F.explode(F.array(*[F.struct(F.lit(n).alias("rating"), F.lit(g).alias("grade")) for n, g in fsrs.GRADES.items()])).alias("g")
    days = retrieval.whole_days(ad.now(), F.col("last_reviewed_at"))
    rows = ad.episodic(spark, sf_dir).select("id", "stability", "difficulty", days.cast("double").alias("days"), grades)
    s = fsrs.next_stability(F.col("stability"), F.col("difficulty"), F.col("days"), F.col("g.grade"))
    return rows.select("id", "g.rating", F.round(s, 5).alias("stability"), F.round(fsrs.next_difficulty(F.col("difficulty"), F.col("g.grade")), 6).alias("difficulty"))


def pending_fifo(spark, sf_dir) -> DataFrame:
    return review.unconsumed(ad.pending(spark, sf_dir)).select("id", "conversation_id", "query")


def queue_drain(spark, sf_dir) -> DataFrame:
    return review.drain(ad.pending(spark, sf_dir), ad.now()).select("id", F.unix_micros("consumed_at").alias("consumed_us"))


def review_aggregate(spark, sf_dir) -> DataFrame:
    """Each memory that waits for a review with its queries in order, and their number."""
    waiting = ad.pending(spark, sf_dir).filter("consumed_at IS NULL")
    return review.asked(waiting).join(review.wanted(waiting), "memory_id").select("memory_id", "n", "position", "query")


def _due(spark, sf_dir) -> DataFrame:
    waiting = review.wanted(ad.pending(spark, sf_dir).filter("consumed_at IS NULL"))
    return review.eligible(waiting, ad.episodic(spark, sf_dir), ad.now())


def review_eligible(spark, sf_dir) -> DataFrame:
    return _due(spark, sf_dir).select("memory_id", "days")


def review_apply(spark, sf_dir) -> DataFrame:
    out = review.apply(_due(spark, sf_dir), ad.ratings(spark, sf_dir), ad.now())
    return out.select("memory_id", "rating", "days", F.round("stability", 5).alias("stability"), F.round("difficulty", 6).alias("difficulty"))


#: No two vectors of the driver's table are as near as the model's threshold, so the queries use a lower one.
NEAR = 0.3


def _probes(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("id").alias("probe_id"), "conversation_id", "embedding", F.col("id").alias("exclude_id"))


def similar_facts(spark, sf_dir) -> DataFrame:
    facts = ad.semantic(spark, sf_dir)
    return retrieval.similar_facts(_probes(facts), facts, NEAR).select("probe_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def dedupe_in_scope(spark, sf_dir) -> DataFrame:
    """Of the similar facts, the first that is in scope (here: guidelines and goals)."""
    facts = ad.semantic(spark, sf_dir)
    scope = facts.filter("category IN ('guideline', 'goal')").select("id")
    found = retrieval.similar_facts(_probes(facts), facts, NEAR).join(scope, "id", "left_semi")
    return found.groupBy("probe_id").agg(F.min_by("id", "rank").alias("id"))


def bm25_block_max(spark, sf_dir) -> DataFrame:
    """The keyword leg over blocks of postings: as bm25_rank, but only blocks that can matter are read."""
    memories, queries = _asked(spark, sf_dir)
    found, _ = block_max.best(*block_max.build(memories), queries, retrieval.LEG_CANDIDATES)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "r")


def vector_index_rank(spark, sf_dir) -> DataFrame:
    """Every twentieth memory against all of its conversation, over inverted lists with residual codes, which go on until nothing better can be left; the candidates are ranked by their own vectors."""
    memories = ad.episodic(spark, sf_dir)
    members = vector_index.stored(memories.select("conversation_id", F.col("id").alias("member"), F.col("embedding").alias("vector")))
    probes = members.filter("member % 20 = 0").select("conversation_id", F.col("member").alias("probe"), "vector")
    means = vector_index.train(members)
    index = vector_index.stored(vector_index.build(members, "conversation_id", means))
    found = vector_index.exact(index, members, probes, "conversation_id", means, LIMIT)
    return found.select(F.col("probe").alias("probe_id"), F.col("member").alias("id"), F.round("score", 6).alias("score"), "r")


def fact_pick_guideline(spark, sf_dir) -> DataFrame:
    facts, queries = _facts(spark, sf_dir)
    found = retrieval.semantic(facts, queries, 20).join(facts.select("id", "category"), "id")
    return consolidation.pick_for_prediction(found).select("query_id", "id", "category", F.col("position").cast("long").alias("position"))


def export_dedup(spark, sf_dir) -> DataFrame:
    """Recent memories and those of a sweep of queries, each once, with how often it was found."""
    memories, queries = _asked(spark, sf_dir)
    swept = retrieval.episodic(memories, queries, ad.now(), LIMIT).select("id")
    latest = retrieval.recent(memories, ad.now(), None, 100).select("id")
    return swept.unionByName(latest).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        hybrid_episodic, hybrid_semantic, hybrid_semantic_category, bm25_rank, vector_rank, rrf_fuse, search_text_, tokenize, postings, term_stats, corpus_stats, embedding_normalize, recent_memories, fsrs_retrievability,
        fsrs_init, fsrs_next_states, pending_fifo, queue_drain, review_aggregate, review_eligible, review_apply, similar_facts, dedupe_in_scope, fact_pick_guideline, export_dedup,
        bm25_block_max, vector_index_rank,
    )
}

_TOKENS = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _legs(view: str, keyword: str = "", vector: str = "") -> dict[str, str]:
    """Common tables up to the fused ranks; keyword and vector: filters of the legs."""
    return {
        "asked": f"SELECT m.conversation_id AS query_id, m.conversation_id, left(m.search_text, 80) AS text, m.embedding FROM {view} m JOIN (SELECT conversation_id, min(id) AS id FROM {view} GROUP BY 1) USING (conversation_id, id)",
        "words": f"SELECT id, conversation_id, {_TOKENS.format(text='search_text')} AS w FROM {view}",
        "postings": "SELECT term, id, conversation_id, dl, count(*) AS tf FROM (SELECT id, conversation_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY 1, 2, 3, 4",
        "df": "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY 1",
        "corpus": "SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(w) AS DOUBLE)) AS avgdl FROM words",
        "terms": f"SELECT query_id, conversation_id, unnest(list_distinct({_TOKENS.format(text='text')})) AS term FROM asked",
        "bm25": """SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
            FROM postings JOIN terms USING (term, conversation_id) JOIN df USING (term), corpus GROUP BY 1, 2""",
        "kw": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM bm25 {keyword}",
        "dots": f"SELECT query_id, m.id, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS score FROM {view} m JOIN asked a USING (conversation_id) {vector}",
        "vec": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM dots",
        "fused": "SELECT query_id, id, sum(1.0 / (30 + r)) AS rrf FROM (SELECT query_id, id, CAST(r AS DOUBLE) AS r FROM kw WHERE r <= 100 UNION ALL SELECT query_id, id, CAST(r AS DOUBLE) FROM vec WHERE r <= 100) GROUP BY 1, 2",
    }


_DAYS = "greatest(0, least(36500, date_diff('microsecond', last_reviewed_at, TIMESTAMP '" + NOW + "') // 86400000000))"
_RECALL = f"pow(1.0 + {fsrs.FACTOR!r} * {{days}} / stability, {-fsrs.DECAY!r})"
_EPISODIC = {
    **_legs("episodic"),
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS n FROM fused) WHERE n <= 100",
    "scored": f"SELECT query_id, id, rrf, {_RECALL.format(days=_DAYS)} AS retrievability, rrf * {_RECALL.format(days=_DAYS)} AS score FROM best JOIN episodic USING (id)",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 9) DESC, id) AS rank FROM scored) WHERE rank <= 10",
}


def _semantic(more: str = "") -> dict[str, str]:
    active = f"(SELECT id FROM semantic WHERE invalid_at IS NULL {more})"
    return {
        **_legs("semantic", f"WHERE id IN {active}", f"WHERE m.id IN {active}"),
        "found": "SELECT * FROM (SELECT query_id, id, rrf AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM fused) WHERE rank <= 20",
    }


def _next_sql(s: str, d: str, t: str, g: str) -> tuple[str, str]:
    """Stability and difficulty after a review, as SQL."""
    import math

    w = fsrs.W
    r = f"pow(1.0 + {fsrs.FACTOR!r} * {t} / {s}, {-fsrs.DECAY!r})"
    extra = f"CASE {g} WHEN 2 THEN {w[15]!r} WHEN 4 THEN {w[16]!r} ELSE 1.0 END"
    recalled = f"{s} * (1 + {math.exp(w[8])!r} * (11.0 - {d}) * pow({s}, {-w[9]!r}) * (exp({w[10]!r} * (1 - {r})) - 1) * {extra})"
    lapsed = f"{w[11]!r} * pow({d}, {-w[12]!r}) * (pow({s} + 1, {w[13]!r}) - 1) * exp({w[14]!r} * (1 - {r}))"
    stability = f"least(36500.0, greatest(0.001, CASE WHEN {g} = 1 THEN least({lapsed}, {s} / {math.exp(w[17] * w[18])!r}) ELSE {recalled} END))"
    difficulty = f"least(10.0, greatest(1.0, {w[7] * fsrs.initial_difficulty(4)!r} + {1 - w[7]!r} * ({d} - {w[6]!r} * ({g} - 3) * (10.0 - {d}) / 9)))"
    return stability, difficulty


_S, _D = _next_sql("CAST(stability AS DOUBLE)", "CAST(difficulty AS DOUBLE)", "days", "grade")
_GRADES = "(VALUES ('again', 1), ('hard', 2), ('good', 3), ('easy', 4)) g(rating, grade)"
_WAITING = "SELECT id, created_at, query, unnest(memory_ids) AS memory_id, generate_subscripts(memory_ids, 1) AS place FROM pending WHERE consumed_at IS NULL"
_DUE = f"SELECT id AS memory_id, stability, difficulty, {_DAYS} AS days FROM episodic WHERE id IN (SELECT memory_id FROM waiting) AND last_reviewed_at < TIMESTAMP '{NOW}' AND {_DAYS} >= 1"
_SIMILAR = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM (
    SELECT p.id AS probe_id, f.id, list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS similarity FROM semantic p JOIN semantic f ON f.conversation_id = p.conversation_id AND f.id <> p.id
    WHERE f.invalid_at IS NULL) WHERE similarity > 0.3) WHERE rank <= 5"""

ORACLE_SQL = {
    "hybrid_episodic": sql("SELECT query_id, rank, id, round(rrf, 6) AS rrf, round(retrievability, 6) AS retrievability, round(score, 6) AS score FROM top", "episodic", **_EPISODIC),
    "hybrid_semantic": sql("SELECT query_id, rank, id, round(score, 6) AS score FROM found", "semantic", **_semantic()),
    "hybrid_semantic_category": sql("SELECT query_id, rank, id, round(score, 6) AS score FROM found", "semantic", **_semantic("AND category = 'guideline'")),
    "bm25_rank": sql("SELECT query_id, id, round(score, 6) AS score, r FROM kw WHERE r <= 100", "episodic", **_legs("episodic")),
    "bm25_block_max": sql("SELECT query_id, id, round(score, 6) AS score, r FROM kw WHERE r <= 100", "episodic", **_legs("episodic")),
    "vector_index_rank": sql(
        """SELECT probe_id, id, round(score, 6) AS score, r FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(score, 9) DESC, id) AS r FROM (
        SELECT p.id AS probe_id, m.id, list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM episodic p JOIN episodic m USING (conversation_id) WHERE p.id % 20 = 0)) WHERE r <= 10""", "episodic"
    ),
    "vector_rank": sql("SELECT query_id, id, round(score, 6) AS score, r FROM vec WHERE r <= 100", "episodic", **_legs("episodic")),
    "rrf_fuse": sql("SELECT query_id, id, round(rrf, 6) AS rrf FROM fused", "episodic", **_legs("episodic")),
    "search_text": sql("SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN title END, '') || ' ' || coalesce(content, '') AS search_text FROM episodic", "episodic"),
    "tokenize": sql("SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place FROM words", "episodic", **{k: v for k, v in _legs("episodic").items() if k == "words"}),
    "postings": sql("SELECT term, id, tf, dl FROM postings", "episodic", **{k: v for k, v in _legs("episodic").items() if k in ("words", "postings")}),
    "term_stats": sql("SELECT * FROM df", "episodic", **{k: v for k, v in _legs("episodic").items() if k in ("words", "postings", "df")}),
    "corpus_stats": sql("SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM corpus", "episodic", **{k: v for k, v in _legs("episodic").items() if k in ("words", "corpus")}),
    "embedding_normalize": f"""SELECT vec_id, generate_subscripts(v, 1) - 1 AS place, round(unnest(v) / norm, 6) AS value FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
        FROM (SELECT vec_id, CAST(embedding[1:{REDUCED_DIM}] AS DOUBLE[]) AS v FROM embeddings))""",
    "recent_memories": sql(f"SELECT id, conversation_id, epoch_us(created_at) AS created_us FROM episodic WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY ORDER BY created_at DESC, id LIMIT 50", "episodic"),
    "fsrs_retrievability": sql(f"SELECT id, {_DAYS} AS days, round({_RECALL.format(days=_DAYS)}, 6) AS retrievability FROM episodic", "episodic"),
    "fsrs_init": sql("SELECT id, CAST(2.3065 AS DOUBLE) AS stability, CAST(round(6.4133 - exp(0.8334 * 2) + 1, 6) AS DOUBLE) AS difficulty FROM episodic", "episodic"),
    "fsrs_next_states": sql(f"SELECT id, rating, round({_S}, 5) AS stability, round({_D}, 6) AS difficulty FROM (SELECT *, CAST({_DAYS} AS DOUBLE) AS days FROM episodic), {_GRADES}", "episodic"),
    "pending_fifo": sql("SELECT id, conversation_id, query FROM pending WHERE consumed_at IS NULL ORDER BY created_at, id", "pending"),
    "queue_drain": sql(f"SELECT id, epoch_us(coalesce(consumed_at, TIMESTAMP '{NOW}')) AS consumed_us FROM pending", "pending"),
    "review_aggregate": sql("SELECT memory_id, count(*) OVER (PARTITION BY memory_id) AS n, row_number() OVER (PARTITION BY memory_id ORDER BY created_at, id, place) - 1 AS position, query FROM waiting", "pending", waiting=_WAITING),
    "review_eligible": sql("SELECT memory_id, days FROM due", "pending", "episodic", waiting=_WAITING, due=_DUE),
    "review_apply": sql(
        f"""SELECT memory_id, rating, CAST(days AS BIGINT) AS days, round({_S}, 5) AS stability, round({_D}, 6) AS difficulty FROM (SELECT memory_id, rating, stability, difficulty, CAST(days AS DOUBLE) AS days, grade FROM due JOIN (
        SELECT memory_id, CASE WHEN lower(arg_min(rating, place)) IN ('again', 'hard', 'easy') THEN lower(arg_min(rating, place)) ELSE 'good' END AS rating FROM ratings GROUP BY 1) USING (memory_id) JOIN {_GRADES} USING (rating))""",
        "pending", "episodic", "ratings", waiting=_WAITING, due=_DUE,
    ),
    "similar_facts": sql("SELECT probe_id, id, round(similarity, 6) AS similarity, rank FROM similar_", "semantic", similar_=_SIMILAR),
    "dedupe_in_scope": sql("SELECT probe_id, arg_min(id, rank) AS id FROM similar_ WHERE id IN (SELECT id FROM semantic WHERE category IN ('guideline', 'goal')) GROUP BY 1", "semantic", similar_=_SIMILAR),
    "fact_pick_guideline": sql(
        """SELECT query_id, id, category, CAST(CASE WHEN g THEN n ELSE n + taken END AS BIGINT) AS position FROM (SELECT *, least(3, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY query_id)) AS taken FROM (
        SELECT query_id, id, category, category = 'guideline' AS g, row_number() OVER (PARTITION BY query_id, category = 'guideline' ORDER BY rank) AS n FROM found JOIN semantic USING (id)))
        WHERE (g AND n <= 3) OR (NOT g AND n <= 10 - taken)""", "semantic", **_semantic()
    ),
    "export_dedup": sql("SELECT id, count(*) AS n FROM (SELECT id FROM top UNION ALL SELECT id FROM (SELECT id FROM episodic ORDER BY created_at DESC, id LIMIT 100)) GROUP BY 1", "episodic", **_EPISODIC),
}

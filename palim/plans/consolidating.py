"""Queries on consolidation: actions and the facts they change, job states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.operators import consolidation as con
from palim.operators import episodes as ep
from palim.sources import adapters as ad
from palim.sources.adapters import NOW, sql


def normalize_actions(spark, sf_dir) -> DataFrame:
    return con.normalize_actions(ad.actions(spark, sf_dir)).select("episode_id", "place", "kind", "fact", "category", "target_fact_id", F.round("confidence", 6).alias("confidence"))


def _keyed(spark, sf_dir) -> DataFrame:
    actions = con.normalize_actions(ad.actions(spark, sf_dir))
    return actions.withColumn("target_fact_id", F.col("target_fact_id").cast("long")).withColumn("episode_id", F.concat(F.lit("e"), F.col("episode_id").cast("string")))


def reinforce_facts(spark, sf_dir) -> DataFrame:
    facts = ad.semantic(spark, sf_dir)
    return con.reinforce(facts, _keyed(spark, sf_dir)).select("id", F.size("source_episodic_ids").cast("long").alias("n"), F.array_join("source_episodic_ids", "|").alias("sources"))


def invalidate_facts(spark, sf_dir) -> DataFrame:
    facts = ad.semantic(spark, sf_dir)
    return con.invalidate(facts, _keyed(spark, sf_dir), ad.now()).select("id", F.unix_micros("invalid_at").alias("invalid_us"))


def unknown_targets(spark, sf_dir) -> DataFrame:
    """Actions on facts that aren't there: skipped, or made new (updates)."""
    facts = ad.semantic(spark, sf_dir).select(F.col("id").alias("target_fact_id"))
    missing = _keyed(spark, sf_dir).filter("kind <> 'new'").join(facts, "target_fact_id", "left_anti")
    return missing.select("episode_id", "place", F.when(F.col("kind") == "update", "new").otherwise("skipped").alias("becomes"))


def to_consolidate(spark, sf_dir) -> DataFrame:
    return ep.to_consolidate(ad.episodic(spark, sf_dir)).select("id", "conversation_id")


def consolidate_apply(spark, sf_dir) -> DataFrame:
    """Every fact's conversation gets the actions of its episodes in order; new facts take the vector of the fact numbered as their place."""
    facts = ad.semantic(spark, sf_dir).select(
        "conversation_id", F.col("id").cast("string").alias("id"), "category", "fact", F.col("source_episodic_ids").alias("sources"), F.col("invalid_at").isNull().alias("valid"), "embedding"
    )
    wanted = con.normalize_actions(ad.actions(spark, sf_dir))
    pos = F.col("episode_id").cast("long")
    place = wanted.withColumn("conversation_id", (pos % 10).cast("string")).withColumn("episode_pos", pos).withColumn("episode_id", F.concat(F.lit("e"), pos.cast("string")))
    vectors = facts.select(F.col("id").alias("__id"), F.col("embedding").alias("__v"), F.col("conversation_id").alias("__c"))
    place = place.join(vectors, F.concat((F.col("episode_pos") % 40 * 10 + F.col("place")).cast("string")) == F.col("__id"), "left").withColumn("embedding", F.when(F.col("kind").isin("new", "update"), F.coalesce("__v", F.array().cast("array<float>"))))
    place = place.filter(~F.col("kind").isin("new", "update") | (F.size("embedding") > 0))
    scope = facts.filter((F.col("id").cast("long") % 10) < 2).select("conversation_id", F.lit(None).cast("string").alias("episode_id"), "id")
    place = place.join(scope.select("conversation_id").distinct(), "conversation_id", "left_semi")
    cols = ("conversation_id", "episode_id", "episode_pos", "place", "kind", "fact", "category", "target_fact_id", "embedding")
    return con.apply_actions(facts, place.select(*cols), scope, 0.3).drop("sources", "embedding")


def job_status(spark, sf_dir) -> DataFrame:
    """Events as jobs: their payload names the conversation, their kind the job's type and state."""
    jobs = ad.table(spark, sf_dir, "events").withColumn("conversation_id", F.get_json_object("props", "$.k"))
    counts = jobs.groupBy("conversation_id").agg(
        F.count_if(F.col("event_type").isin("view", "click")).alias("waiting"), F.count_if(F.col("event_type").like("err%")).alias("failed"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > 50)).alias("running")
    )
    return counts.withColumn("done", (F.col("waiting") == 0) & (F.col("failed") == 0) & (F.col("running") == 0))


QUERIES = {f.__name__: f for f in (normalize_actions, reinforce_facts, invalidate_facts, unknown_targets, to_consolidate, consolidate_apply, job_status)}

_CLEAN = """SELECT *, kind <> 'new' AS targeted FROM (SELECT episode_id, place, kind, CASE WHEN kind = 'invalidate' THEN '' ELSE trim(fact) END AS fact,
    CASE WHEN lower(trim(category)) IN ('identity', 'preference', 'interest', 'personality', 'relationship', 'experience', 'goal', 'guideline') THEN lower(trim(category)) ELSE 'identity' END AS category,
    trim(target_fact_id) AS target_fact_id, least(1.0, greatest(0.0, confidence)) AS confidence FROM actions)
    WHERE NOT (kind IN ('new', 'update') AND fact = '') AND NOT (kind IN ('reinforce', 'invalidate') AND target_fact_id = '')"""
_NORMAL = """SELECT episode_id, place, kind, fact, category, target_fact_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, CASE WHEN targeted THEN 't:' || target_fact_id ELSE 'n:' || place END
    ORDER BY CASE kind WHEN 'update' THEN 3 WHEN 'invalidate' THEN 2 WHEN 'reinforce' THEN 1 ELSE 0 END DESC, place) AS n
    FROM (SELECT * REPLACE (CASE WHEN kind = 'update' AND target_fact_id = '' THEN 'new' ELSE kind END AS kind) FROM clean)) WHERE n = 1"""
_N = {"clean": _CLEAN, "normal": _NORMAL}
#: The fold, action by action: `valid` and `scope` are lists of ids; a step tells what it made, what it added a source to, and what it ended.
_FACTS = "SELECT conversation_id, CAST(id AS VARCHAR) AS id, category, fact, source_episodic_ids AS sources, invalid_at IS NULL AS valid, embedding FROM semantic"
_ACTS = """SELECT conversation_id, pos, place, 'e' || pos AS episode, kind, fact, category, target, vector, row_number() OVER (PARTITION BY conversation_id ORDER BY pos, place) AS n,
    row_number() OVER (PARTITION BY conversation_id, pos ORDER BY place) = 1 AS opens FROM (
    SELECT CAST(n.episode_id % 10 AS VARCHAR) AS conversation_id, n.episode_id AS pos, n.place, n.kind, n.fact, n.category, n.target_fact_id AS target, CASE WHEN n.kind IN ('new', 'update') THEN f.embedding END AS vector
    FROM normal n LEFT JOIN facts f ON f.id = CAST(n.episode_id % 40 * 10 + n.place AS VARCHAR) WHERE n.kind NOT IN ('new', 'update') OR f.id IS NOT NULL)
    WHERE conversation_id IN (SELECT conversation_id FROM scopes)"""
_SCOPES_OF = "SELECT conversation_id, list(id ORDER BY id) AS scope FROM facts WHERE CAST(id AS BIGINT) % 10 < 2 GROUP BY 1"
_POOL = "SELECT conversation_id, id, embedding FROM facts UNION ALL SELECT conversation_id, episode || '/' || place, vector FROM acts WHERE vector IS NOT NULL"
_NEARBY = """SELECT conversation_id, n, list(id ORDER BY round(s, 9) DESC, id) AS nearby FROM (SELECT a.conversation_id, a.n, p.id, list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(a.vector AS DOUBLE[])) AS s
    FROM acts a JOIN pool p USING (conversation_id) WHERE a.vector IS NOT NULL) WHERE s > 0.3 GROUP BY 1, 2"""
_STEPS = """SELECT a.*, coalesce(b.nearby, []) AS nearby FROM acts a LEFT JOIN nearby b USING (conversation_id, n)"""
_RUN = """SELECT conversation_id, 0 AS n, list(id) FILTER (WHERE valid) AS valid, CAST([] AS VARCHAR[]) AS scope, CAST(NULL AS VARCHAR) AS made, CAST(NULL AS VARCHAR) AS added, CAST(NULL AS VARCHAR) AS ended FROM facts GROUP BY 1
    UNION ALL SELECT conversation_id, n, CASE WHEN made IS NULL THEN rest ELSE list_append(rest, made) END, CASE WHEN made IS NULL THEN inner_ ELSE list_append(inner_, made) END, made, added, ended FROM (
    SELECT conversation_id, n, CASE WHEN ended IS NULL THEN valid ELSE list_filter(valid, lambda x: x <> ended) END AS rest, CASE WHEN ended IS NULL THEN scope ELSE list_filter(scope, lambda x: x <> ended) END AS inner_,
    CASE WHEN settles AND found IS NULL THEN key END AS made, CASE WHEN kind = 'reinforce' THEN CASE WHEN hit THEN target END WHEN settles THEN found END AS added, ended FROM (
    SELECT *, list_filter(list_filter(nearby, lambda x: list_contains(valid, x) AND x <> coalesce(ended, ''))[1:5], lambda x: list_contains(scope, x))[1] AS found FROM (
    SELECT *, list_contains(scope, target) AS hit, kind IN ('new', 'update') AS settles, CASE WHEN kind IN ('invalidate', 'update') AND list_contains(scope, target) THEN target END AS ended FROM (
    SELECT a.conversation_id, a.n, a.kind, a.target, a.nearby, a.episode || '/' || a.place AS key, r.valid, CASE WHEN a.opens THEN list_filter(o.scope, lambda x: list_contains(r.valid, x)) ELSE r.scope END AS scope
    FROM run r JOIN steps a ON a.conversation_id = r.conversation_id AND a.n = r.n + 1 JOIN scopes o ON o.conversation_id = r.conversation_id))))"""
_APPLIED = """SELECT conversation_id, id, category, fact, CAST(len(list_distinct(list_concat(sources, coalesce(more, [])))) AS INTEGER) AS source_count, list_contains(valid, id) AS active
    FROM (SELECT conversation_id, id, category, fact, sources FROM facts UNION ALL SELECT a.conversation_id, r.made, a.category, a.fact, [a.episode] FROM run r JOIN acts a USING (conversation_id, n) WHERE r.made IS NOT NULL)
    LEFT JOIN (SELECT r.conversation_id, r.added AS id, list(a.episode) AS more FROM run r JOIN acts a USING (conversation_id, n) WHERE r.added IS NOT NULL GROUP BY 1, 2) USING (conversation_id, id)
    JOIN (SELECT conversation_id, arg_max(valid, n) AS valid FROM run GROUP BY 1) USING (conversation_id)"""

ORACLE_SQL = {
    "normalize_actions": sql("SELECT * REPLACE (round(confidence, 6) AS confidence) FROM normal", "actions", **_N),
    "reinforce_facts": sql(
        """SELECT id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS sources FROM (SELECT id, list_concat(source_episodic_ids, list_filter(coalesce(more, []), lambda x: NOT list_contains(source_episodic_ids, x))) AS s
        FROM semantic LEFT JOIN (SELECT CAST(target_fact_id AS BIGINT) AS id, list_sort(list(DISTINCT 'e' || episode_id)) AS more FROM normal WHERE kind = 'reinforce' GROUP BY 1) USING (id))""", "actions", "semantic", **_N
    ),
    "invalidate_facts": sql(
        f"SELECT id, epoch_us(CASE WHEN id IN (SELECT CAST(target_fact_id AS BIGINT) FROM normal WHERE kind = 'invalidate') THEN coalesce(invalid_at, TIMESTAMP '{NOW}') ELSE invalid_at END) AS invalid_us FROM semantic", "actions", "semantic", **_N
    ),
    "unknown_targets": sql(
        "SELECT 'e' || episode_id AS episode_id, place, CASE WHEN kind = 'update' THEN 'new' ELSE 'skipped' END AS becomes FROM normal WHERE kind <> 'new' AND CAST(target_fact_id AS BIGINT) NOT IN (SELECT id FROM semantic)", "actions", "semantic", **_N
    ),
    "consolidate_apply": sql(
        _APPLIED, "actions", "semantic", recursive=True, once=("semantic", "normal", "facts", "scopes", "acts", "steps"), **_N, facts=_FACTS, scopes=_SCOPES_OF, acts=_ACTS, pool=_POOL, nearby=_NEARBY, steps=_STEPS, run=_RUN
    ),
    "to_consolidate": sql("SELECT id, conversation_id FROM episodic WHERE classification = 'informative' AND consolidated_at IS NULL", "episodic"),
    "job_status": """SELECT *, waiting = 0 AND failed = 0 AND running = 0 AS done FROM (SELECT props ->> '$.k' AS conversation_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS waiting,
        count(*) FILTER (WHERE event_type LIKE 'err%') AS failed, count(*) FILTER (WHERE event_type = 'signup' AND value > 50) AS running FROM events GROUP BY 1)""",
}

"""Queries on question answering results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palim.functions.text import judge_label, verdict
from palim.operators import evaluation as ev
from palim.schemas import QUESTION_TYPES
from palim.sources import adapters as ad
from palim.sources.adapters import sql


def _scored(spark, sf_dir) -> DataFrame:
    """Results with their three metrics; the judge's word is a stand-in from the turn."""
    qa = ad.qa(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, ("CORRECT", " partial ", "WRONG because", "CORRECT.", "Partial: half"))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return qa.withColumns(
        {"raw": label, "judge": judge_label(label), "set_f1": ev.set_f1(F.col("prediction"), F.col("gold")), "score": ev.category_score(F.col("category"), F.col("prediction"), F.col("gold"))}
    )


def token_f1(spark, sf_dir) -> DataFrame:
    return ad.qa(spark, sf_dir).select("conv_id", "turn", F.round(ev.token_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


def set_f1(spark, sf_dir) -> DataFrame:
    return ad.qa(spark, sf_dir).select("conv_id", "turn", F.round(ev.set_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


def multi_answer_f1(spark, sf_dir) -> DataFrame:
    return ad.qa(spark, sf_dir).select("conv_id", "turn", F.round(ev.multi_answer_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


def category_score(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", "turn", "category", F.round("score", 6).alias("score"))


def judge_labels(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).select("conv_id", "turn", "judge", verdict(F.col("raw")).alias("binary"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_summary(spark, sf_dir) -> DataFrame:
    return _rounded(ev.by_category(_scored(spark, sf_dir)))


def score_by_sample(spark, sf_dir) -> DataFrame:
    return _rounded(ev.summaries(_scored(spark, sf_dir)))


def score_delta(spark, sf_dir) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return _rounded(ev.deltas(rows.filter("turn % 4 = 0"), rows.filter("turn % 4 <> 0 AND conv_id % 3 = 0"), "sample_id"))


def _typed(spark, sf_dir) -> DataFrame:
    """Results with a question id and a type; one of the six types has none."""
    kind = F.element_at(F.array(*map(F.lit, QUESTION_TYPES)), (F.col("conv_id") % 5 + 1).cast("int"))
    return _scored(spark, sf_dir).withColumns({"question_type": kind, "question_id": F.concat_ws(":", "conv_id", "turn"), "correct": verdict(F.col("raw"))})


def question_type_stats(spark, sf_dir) -> DataFrame:
    """Mean binary verdict by question type, all six, and overall."""
    return _rounded(ev.by_question_type(_typed(spark, sf_dir)))


def question_type_histogram(spark, sf_dir) -> DataFrame:
    return ev.type_histogram(_typed(spark, sf_dir))


def results_by_question(spark, sf_dir) -> DataFrame:
    """All questions of the dataset with the results of those that have one."""
    rows = _typed(spark, sf_dir)
    results = rows.filter("conv_id % 4 <> 0").select("question_id", "judge", "correct")
    return ev.with_results(rows.select("question_id", "question_type"), results)


def delta_summary(spark, sf_dir) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return _rounded(ev.delta_summary(rows.filter("turn % 4 = 0"), rows.filter("turn % 4 <> 0 AND conv_id % 3 = 0")))


def gold_coverage(spark, sf_dir) -> DataFrame:
    rows = ad.qa(spark, sf_dir).withColumn("inside", ev.covered(F.concat("prediction", F.lit(", "), F.when(F.col("turn") % 4 == 0, F.col("gold")).otherwise("")), F.col("prediction")))
    return rows.groupBy("category").agg(F.count_if("inside").alias("covered"), F.count_if(~F.col("inside")).alias("missing"))


def context_composition(spark, sf_dir) -> DataFrame:
    context = F.concat(F.lit("Spoken At: x\n- "), F.replace("prediction", F.lit(". "), F.lit(".\n- ")))
    return ad.qa(spark, sf_dir).select("conv_id", "turn", F.regexp_count(context, F.lit("Spoken At:")).cast("long").alias("episodes"), F.regexp_count(context, F.lit("(?m)^- ")).cast("long").alias("facts"))


def pending_qa_anti(spark, sf_dir) -> DataFrame:
    """Questions without a result yet, by category and question; category 5 isn't asked."""
    qa = ad.qa(spark, sf_dir).filter("category <> 5").withColumn("key", F.concat_ws(":", "sample_id", "category", "question"))
    done = qa.filter("conv_id % 4 = 0").select("key").distinct()
    return qa.join(done, "key", "left_anti").select("key", "conv_id", "turn")


def top_n_per_type(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("category").orderBy("conv_id", "turn")
    return ad.qa(spark, sf_dir).withColumn("n", F.row_number().over(order).cast("long")).filter("n <= 5").select("category", "n", "conv_id", "turn")


QUERIES = {
    f.__name__: f
    for f in (token_f1, set_f1, multi_answer_f1, category_score, judge_labels, score_summary, score_by_sample, score_delta, delta_summary, question_type_stats, question_type_histogram, results_by_question, gold_coverage, context_composition, pending_qa_anti, top_n_per_type)
}


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'and', 'the'))"


def _f1_sql(prediction: str, gold: str) -> str:
    p, g = _tokens(prediction), _tokens(gold)
    same = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w))))), 0)"
    return f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 OR {same} = 0 THEN 0.0 ELSE 2.0 * {same} / (len({p}) + len({g})) END"


_PARTS = "list_filter(list_transform(string_split(gold, ','), lambda s: trim(s)), lambda s: s <> '')"
_SET = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(trim({t})), '[.,!?]', ' ', 'g'), '\\s+'), lambda w: w <> ''))"
_SET_F1 = f"CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END"
_SETS = f"SELECT *, {_SET.format(t='prediction')} AS p, {_SET.format(t='gold')} AS g FROM qa"
_MULTI = f"SELECT conv_id, turn, avg({_f1_sql('prediction', 'part')}) AS f1 FROM (SELECT conv_id, turn, prediction, unnest({_PARTS}) AS part FROM qa) GROUP BY 1, 2"
_RAW = "['CORRECT', ' partial ', 'WRONG because', 'CORRECT.', 'Partial: half'][1 + (conv_id + turn) % 5]"
_SCORED = f"""SELECT conv_id, turn, sample_id, category, question, {_RAW} AS raw, CASE split_part(upper(trim({_RAW})), ' ', 1) WHEN 'CORRECT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END AS judge, {_SET_F1} AS set_f1,
    CASE category WHEN 1 THEN coalesce(f1, 0) WHEN 3 THEN {_f1_sql('prediction', "trim(split_part(gold, ';', 1))")} WHEN 5 THEN CASE WHEN contains(lower(prediction), 'no information') OR contains(lower(prediction), 'not mentioned') THEN 1.0 ELSE 0.0 END
    ELSE {_f1_sql('prediction', 'gold')} END AS score FROM sets LEFT JOIN multi USING (conv_id, turn)"""
_TYPES = "[" + ", ".join(f"'{t}'" for t in QUESTION_TYPES) + "]"
_KINDS = f"SELECT *, {_TYPES}[1 + conv_id % 5] AS question_type, conv_id || ':' || turn AS question_id, CASE WHEN starts_with(upper(trim(raw)), 'CORRECT') THEN 1.0 ELSE 0.0 END AS correct FROM scored"
_SCOPES = """SELECT CASE grouping(category, sample_id) WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'sample' END AS scope, CASE grouping(category, sample_id) WHEN 3 THEN '' WHEN 1 THEN CAST(category AS VARCHAR) ELSE sample_id END AS key,
    avg(score) AS score, avg(set_f1) AS set_f1, avg(judge) AS judge FROM scored WHERE {rows} GROUP BY GROUPING SETS ((), (category), (sample_id))"""
_S = {"sets": _SETS, "multi": _MULTI, "scored": _SCORED}
_MEANS = "round(coalesce(avg(score), 0), 6) AS score, round(coalesce(avg(set_f1), 0), 6) AS set_f1, round(coalesce(avg(judge), 0), 6) AS judge"

ORACLE_SQL = {
    "token_f1": sql(f"SELECT conv_id, turn, round({_f1_sql('prediction', 'gold')}, 6) AS f1 FROM qa", "qa"),
    "set_f1": sql(f"SELECT conv_id, turn, round({_SET_F1}, 6) AS f1 FROM sets", "qa", sets=_SETS),
    "multi_answer_f1": sql("SELECT conv_id, turn, round(coalesce(f1, 0), 6) AS f1 FROM qa LEFT JOIN multi USING (conv_id, turn)", "qa", multi=_MULTI),
    "category_score": sql("SELECT conv_id, turn, category, round(score, 6) AS score FROM scored", "qa", **_S),
    "judge_labels": sql("SELECT conv_id, turn, CAST(judge AS DOUBLE) AS judge, CAST(CASE WHEN starts_with(upper(trim(raw)), 'CORRECT') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS binary FROM scored", "qa", **_S),
    "score_summary": sql(f"SELECT c.category, count(conv_id) AS n, {_MEANS} FROM (SELECT unnest([1, 2, 3, 4, 5]) AS category) c LEFT JOIN scored USING (category) GROUP BY 1", "qa", **_S),
    "score_by_sample": sql(f"SELECT sample_id, category, grouping(sample_id, category) AS level, count(*) AS n, {_MEANS} FROM scored GROUP BY GROUPING SETS ((sample_id, category), (sample_id), (category), ())", "qa", **_S),
    "score_delta": sql(
        """SELECT sample_id, """ + ", ".join(f"round(coalesce(a.{m}, 0) - coalesce(b.{m}, 0), 6) AS {m}_delta" for m in ev.METRICS) + " FROM (SELECT sample_id, avg(score) AS score, avg(set_f1) AS set_f1, avg(judge) AS judge FROM scored WHERE turn % 4 = 0 GROUP BY 1) a "
        "FULL JOIN (SELECT sample_id, avg(score) AS score, avg(set_f1) AS set_f1, avg(judge) AS judge FROM scored WHERE turn % 4 <> 0 AND conv_id % 3 = 0 GROUP BY 1) b USING (sample_id)", "qa", **_S
    ),
    "delta_summary": sql(
        "SELECT scope, key, " + ", ".join(f"round(coalesce(a.{m}, 0) - coalesce(b.{m}, 0), 6) AS {m}_delta" for m in ev.METRICS) + f" FROM ({_SCOPES.format(rows='turn % 4 = 0')}) a FULL JOIN ({_SCOPES.format(rows='turn % 4 <> 0 AND conv_id % 3 = 0')}) b USING (scope, key)", "qa", **_S
    ),
    "question_type_stats": sql(
        f"""SELECT question_type, coalesce(n, 0) AS n, CAST(coalesce(accuracy, 0) AS DOUBLE) AS accuracy FROM (SELECT unnest({_TYPES} || ['overall']) AS question_type) LEFT JOIN (
        SELECT question_type, count(*) AS n, round(avg(correct), 6) AS accuracy FROM kinds GROUP BY 1 UNION ALL SELECT 'overall', count(*), round(avg(correct), 6) FROM kinds) USING (question_type)""", "qa", **_S, kinds=_KINDS
    ),
    "question_type_histogram": sql(f"SELECT question_type, coalesce(n, 0) AS n FROM (SELECT unnest({_TYPES}) AS question_type) LEFT JOIN (SELECT question_type, count(*) AS n FROM kinds GROUP BY 1) USING (question_type)", "qa", **_S, kinds=_KINDS),
    "results_by_question": sql(
        "SELECT question_id, question_type, CAST(r.judge AS DOUBLE) AS judge, CAST(r.correct AS DOUBLE) AS correct FROM kinds LEFT JOIN (SELECT question_id, judge, correct FROM kinds WHERE conv_id % 4 <> 0) r USING (question_id)", "qa", **_S, kinds=_KINDS
    ),
    "gold_coverage": sql(
        """SELECT category, count(*) FILTER (WHERE inside) AS covered, count(*) FILTER (WHERE NOT inside) AS missing FROM (SELECT category, len(list_filter(list_filter(list_transform(regexp_split_to_array(lower(
        prediction || ', ' || CASE WHEN turn % 4 = 0 THEN gold ELSE '' END), ',|\\band\\b'), lambda s: regexp_replace(trim(s), '[''"]', '', 'g')), lambda s: length(s) > 2), lambda s: NOT contains(lower(prediction), s))) = 0 AS inside FROM qa) GROUP BY 1""", "qa"
    ),
    "context_composition": sql(
        """SELECT conv_id, turn, CAST(len(regexp_extract_all(c, 'Spoken At:')) AS BIGINT) AS episodes, CAST(len(regexp_extract_all(c, '(?m)^- ')) AS BIGINT) AS facts FROM (
        SELECT conv_id, turn, 'Spoken At: x' || chr(10) || '- ' || replace(prediction, '. ', '.' || chr(10) || '- ') AS c FROM qa)""", "qa"
    ),
    "pending_qa_anti": sql(
        """SELECT key, conv_id, turn FROM keyed WHERE key NOT IN (SELECT key FROM keyed WHERE conv_id % 4 = 0)""", "qa", keyed="SELECT *, concat_ws(':', sample_id, category, question) AS key FROM qa WHERE category <> 5"
    ),
    "top_n_per_type": sql("SELECT category, n, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY conv_id, turn) AS n FROM qa) WHERE n <= 5", "qa"),
}

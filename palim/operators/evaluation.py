"""Scores of question answering and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.functions.text import answer_tokens, let, set_tokens
from palim.schemas import QA_CATEGORIES, QUESTION_TYPES


def _f1(same: Column, predicted: Column, gold: Column) -> Column:
    return F.when(same == 0, 0.0).otherwise(2 * same / (predicted + gold))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 over tokens with their counts; both empty: 1, one empty: 0."""
    return let(answer_tokens(prediction), lambda a: let(answer_tokens(gold), lambda b: _counted_f1(a, b)))


def _counted_f1(a: Column, b: Column) -> Column:
    def count(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    same = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(same, lambda s: _f1(s, F.size(a), F.size(b))))


def set_f1(prediction: Column, gold: Column) -> Column:
    """F1 over distinct tokens; any side empty: 0."""

    def score(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(let(F.size(F.array_intersect(a, b)), lambda s: _f1(s, F.size(a), F.size(b))))

    return let(set_tokens(F.trim(prediction)), lambda a: let(set_tokens(F.trim(gold)), lambda b: score(a, b)))


def multi_answer_f1(prediction: Column, gold: Column) -> Column:
    """The mean token F1 over the parts of the gold answer between commas; no part: 0."""

    def mean(a: Column, parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda s, part: s + let(answer_tokens(part), lambda b: _counted_f1(a, b)))
        return F.when(F.size(parts) == 0, 0.0).otherwise(total / F.size(parts))

    parts = F.filter(F.transform(F.split(gold, ","), F.trim), lambda s: s != "")
    return let(answer_tokens(prediction), lambda a: let(parts, lambda p: mean(a, p)))


def first_answer_f1(prediction: Column, gold: Column) -> Column:
    return token_f1(prediction, F.trim(F.split(gold, ";")[0]))


def absent_score(prediction: Column) -> Column:
    text = F.lower(prediction)
    return F.when(text.contains("no information") | text.contains("not mentioned"), 1.0).otherwise(0.0)


def category_score(category: Column, prediction: Column, gold: Column) -> Column:
    return (
        F.when(category == 1, multi_answer_f1(prediction, gold))
        .when(category.isin(2, 4), token_f1(prediction, gold))
        .when(category == 3, first_answer_f1(prediction, gold))
        .when(category == 5, absent_score(prediction))
    )


def covered(gold: Column, context: Column) -> Column:
    """All parts of the gold answer (between commas and the word `and`, over 2 characters) stand in the context."""
    items = F.transform(F.split(F.lower(gold), r",|\band\b"), lambda s: F.regexp_replace(F.trim(s), "['\"]", ""))
    return F.forall(F.filter(items, lambda s: F.length(s) > 2), lambda s: F.contains(F.lower(context), s))


METRICS = ("score", "set_f1", "judge")


def summaries(results: DataFrame) -> DataFrame:
    """Means and counts by sample and category, by sample, by category, and overall, in one pass. level says which."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS]
    grouped = results.groupingSets([["sample_id", "category"], ["sample_id"], ["category"], []], "sample_id", "category").agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), *means
    )
    return grouped


def by_category(results: DataFrame) -> DataFrame:
    """A row for each category, also where no result has it (0, not null)."""
    spark = results.sparkSession
    spine = spark.createDataFrame([(c,) for c in QA_CATEGORIES], "category int")
    found = results.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS])
    return F.broadcast(spine).join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def by_question_type(results: DataFrame) -> DataFrame:
    """question_type, n and accuracy (mean of `correct`) for each of the six types, also where no result has it (0), and overall."""
    spark = results.sparkSession
    spine = spark.createDataFrame([(t,) for t in (*QUESTION_TYPES, "overall")], "question_type string")
    found = results.rollup("question_type").agg(F.grouping("question_type").alias("all"), F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
    found = found.withColumn("question_type", F.when(F.col("all") == 1, "overall").otherwise(F.col("question_type"))).drop("all")
    return F.broadcast(spine).join(found, "question_type", "left").select("question_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def type_histogram(samples: DataFrame) -> DataFrame:
    """How many samples each of the six question types has, zeros included."""
    spine = samples.sparkSession.createDataFrame([(t,) for t in QUESTION_TYPES], "question_type string")
    return F.broadcast(spine).join(samples.groupBy("question_type").agg(F.count(F.lit(1)).alias("n")), "question_type", "left").select("question_type", F.coalesce("n", F.lit(0)).alias("n"))


def with_results(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples, each with its result (columns of results, null where there is none) by question_id."""
    return samples.join(results, "question_id", "left")


def delta_summary(variant: DataFrame, baseline: DataFrame) -> DataFrame:
    """Variant less baseline overall, by category and by sample, in one pass over each: scope, key and the deltas. A missing side counts as 0."""

    def means(rows: DataFrame, side: str) -> DataFrame:
        grouped = rows.groupingSets([[], ["category"], ["sample_id"]], "category", "sample_id").agg(F.grouping_id().alias("level"), *[F.avg(m).alias(f"{side}_{m}") for m in METRICS])
        scope = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, "category").otherwise("sample")
        key = F.when(F.col("level") == 3, "").when(F.col("level") == 1, F.col("category").cast("string")).otherwise(F.col("sample_id"))
        return grouped.select(scope.alias("scope"), key.alias("key"), *[f"{side}_{m}" for m in METRICS])

    both = means(variant, "a").join(means(baseline, "b"), ["scope", "key"], "full_outer")
    return both.select("scope", "key", *[(F.coalesce(f"a_{m}", F.lit(0.0)) - F.coalesce(f"b_{m}", F.lit(0.0))).alias(f"{m}_delta") for m in METRICS])


def deltas(variant: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Variant less baseline for each key of either side; a missing side counts as 0."""
    a = variant.groupBy(key).agg(*[F.avg(m).alias(f"a_{m}") for m in METRICS])
    b = baseline.groupBy(key).agg(*[F.avg(m).alias(f"b_{m}") for m in METRICS])
    both = a.join(b, key, "full_outer")
    return both.select(key, *[(F.coalesce(f"a_{m}", F.lit(0.0)) - F.coalesce(f"b_{m}", F.lit(0.0))).alias(f"{m}_delta") for m in METRICS])

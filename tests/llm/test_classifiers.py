import numpy as np
import pytest
from pyspark.sql import functions as F

from palim.llm import language, quality, toxicity
from palim.llm.common import held_out
from tests.llm.helpers import awkward, documents, empty, prose

LANGS = {"en": "the and of with that this which from were", "de": "der und das nicht mit eine auch sich werden", "fr": "le et des dans une pour est avec que", "es": "el y los para una con del pero como"}


def _texts(words: str, n: int, seed: int) -> list[str]:
    rng, pool = np.random.default_rng(seed), words.split()
    return [" ".join(rng.choice(pool, 30)) for _ in range(n)]


def test_languages(spark):
    rows = [(t, lang) for k, (lang, words) in enumerate(LANGS.items()) for t in _texts(words, 40, k)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(docs.filter(~held_out(5, 0)))
    assert sorted(model.families) == ["germanic", "romance"]
    assert len(model.duels) == 2  # within the families only
    got = language.identify(docs, model).join(docs, "doc_id")
    assert got.filter("held_out AND lang_pred <> lang").count() == 0
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert language.identify(docs, model).count() == docs.count()
    assert [got[k]["lang_pred"] for k in (60, 61, 62)] == ["und"] * 3
    assert got[60]["score"] == 0.0
    assert language.train(empty(spark)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(empty(spark), model).count() == 0


def _labelled(spark, good, bad, label):
    texts = good + bad
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))], f"doc_id long, {label} int")
    return docs, labels


def test_quality(spark):
    good = [prose(i, 60) for i in range(120)]
    bad = [f"{prose(i, 1)} " * 40 for i in range(40)] + [" | ".join(prose(i, 30).split()) for i in range(40)]
    docs, labels = _labelled(spark, good, bad, "quality")
    model = quality.train(docs, labels)
    got = [(r["score"], r["quality"], r["predicted"]) for r in quality.score(docs, model).join(labels, "doc_id").filter("held_out").collect()]
    low, high = ([s for s, q, _ in got if q == k] for k in (0, 1))
    assert min(len(low), len(high)) >= 10
    assert sum(a < b for a in low for b in high) >= 0.98 * len(low) * len(high)
    assert sum(p == q for _, q, p in got) >= 0.9 * len(got)


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    clean = [prose(i, 60) for i in range(200)]
    toxic = []
    for i in range(60):
        words = prose(1000 + i, 60).split()
        for j in rng.integers(0, 60, 3):
            words[j] = str(rng.choice(["idiot", "grobnik", "grobnak", "you stupid"]))
        toxic.append(" ".join(words))
    docs = documents(spark, clean + toxic)
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted <> toxic").count() <= 2
    assert (np.diff(model.levels) >= 0).all()  # calibration keeps the order
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id < 200").count() >= 198


def test_disguised_words():
    import pyarrow as pa

    lexicon = toxicity.word_hashes(toxicity.SEEDS)
    person = toxicity.word_hashes(toxicity.SECOND_PERSON)
    from palim.llm.common import utf8

    x = toxicity.features(*utf8(pa.array(["you are an 1d10t", "you are an i.d.i.o.t", "IDIOT!!", "nothing here", ""])), lexicon, person)
    at = toxicity.FEATURES.index("hits")
    assert x[:, at].tolist() == [1, 1, 1, 0, 0]


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    steps, levels = toxicity.isotonic(x, y, np.ones(4))
    assert levels.tolist() == [0.0, 0.5, 1.0]
    assert steps.tolist() == [1.0, 2.5, 4.0]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scorers_take_awkward_rows(spark, module):
    docs = awkward(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), F.lit("x").alias("text")).unionByName(
        spark.createDataFrame([(None, 1, 1, "x"), (1, None, None, "x"), (10**9, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    )
    model = module.train(docs, labels)
    got = module.score(docs, model)
    assert got.count() == docs.count()
    assert got.filter("score IS NULL OR score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.3)").count() == 0
    assert module.train(docs, labels.filter("doc_id < -5")) is None
    assert module.score(docs, None).count() == docs.count()
    assert module.score(empty(spark), model).count() == 0

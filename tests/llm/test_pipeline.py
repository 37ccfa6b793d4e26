import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palim.llm import queries
from palim.llm.common import materialise
from tests.llm.helpers import awkward, empty, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    awkward(spark).unionByName(spark.createDataFrame([(500 + i, prose(500 + i, 60) + (" idiot scum" if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(500 + i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, prose(9, 40)), (1, prose(5000, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.schema == docs.schema, name
        before, after = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if name == "toxicity":
            assert not after & {500 + i for i in range(0, 90, 3)}
            assert {500 + i for i in range(90) if i % 3} <= after
        if name == "simhash_near_dedup":
            assert 3 in after and not after & {65, 66}
        if name == "benchmark_decontamination":
            assert before - after == {9}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.filter(F.size("pieces") > 0).count() > 50


def test_stages_take_empty_tables(spark, tables):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name


def _words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def _shingles(text, n=5):
    words = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_near_duplicates(docs):
    """Of each group of linked texts (shingle sets of similarity 0.8) the least id stays; rows without an id stay. docs: (id, text)."""
    known = [(i, t) for i, t in docs if i is not None]
    sets, group = [_shingles(t) for _, t in known], list(range(len(known)))
    for x in range(len(known)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if (not sets[x] and not sets[y]) or both >= 0.8 * len(sets[x] | sets[y]) > 0:
                old, new = sorted((group[x], group[y]), reverse=True)
                group = [new if g == old else g for g in group]
    least = {g: min(known[k][0] for k in range(len(known)) if group[k] == g) for g in set(group)}
    return sorted([(i, t) for k, (i, t) in enumerate(known) if least[group[k]] == i] + [r for r in docs if r[0] is None], key=str)


def brute_passages(docs):
    """Words in windows of 13 that start in a document with a lesser id go; so do documents of which nothing is left."""
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in docs:
        w = _words(t)
        for s in range(len(w) - 12):
            window = tuple(w[s : s + 13])
            first[window] = min(first.get(window, key(i)), key(i))
    out = []
    for i, t in docs:
        w = _words(t)
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < key(i) for p in range(s, s + 13)}
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def test_run_equals_the_stages(spark, tables):
    """Each stage against its definition on all that the one before kept, and run() against the stages."""
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    extra = [(600, " ".join(_words(prose(510, 60))[:59])), (601, prose(514, 30) + " and then " + prose(9001, 30)), (602, prose(9002, 20) + " " + prose(5000, 30)), (603, prose(514, 13))]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    folder = f"{tables}_more"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    docs, before, own = spark.read.parquet(f"{folder}/documents.parquet"), None, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = rows(docs), materialise(stage(spark, docs, folder))
        own[name] = rows(docs)
        if name == "toxicity":
            assert own[name] == sorted([r for r in before if not (r[1] or "").endswith(" idiot scum")], key=str)
        if name == "simhash_near_dedup":
            assert own[name] == brute_near_duplicates(before) and len(own[name]) < len(before)
        if name == "substring_dedup":
            assert own[name] == brute_passages(before) and own[name] != before
        if name == "benchmark_decontamination":
            runs = {tuple(q[k : k + 13]) for q in (_words(prose(9, 40)), _words(prose(5000, 30))) for k in range(len(q) - 12)}
            holds = lambda t: any(tuple(_words(t)[k : k + 13]) in runs for k in range(len(_words(t))))
            assert own[name] == sorted([r for r in before if not holds(r[1])], key=str) and len(own[name]) < len(before)
    tokens = sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == tokens and len(tokens) == len(own["benchmark_decontamination"])


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_rows_without_an_id_or_with_one_id_are_judged_by_their_own_text(spark, tables):
    """One dirty row, one copy: the clean rows of the same id, or of none, stay in every stage."""
    question, clean = prose(9, 40), [prose(700 + i, 60) for i in range(6)]
    rows = [(None, f"{clean[0]} {question}"), (None, clean[1]), (5, f"{clean[2]} {question}"), (5, clean[3]), (2, clean[4]), (7, clean[4]), (7, clean[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs, tables).collect()}
    assert left == {r for r in rows if question not in r[1]}
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, tables).collect()}
    assert left == {r for r in rows if r != (7, clean[4])}

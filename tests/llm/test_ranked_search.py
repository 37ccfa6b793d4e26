import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palim.llm import ranked_search
from palim.llm.ranked_search import Block, Terms, _Best, top_documents


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    words = [(i, terms_of(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, w in words:
            m, score = 100 - 90 + (90 * len(w) * n_docs) // total, 0
            for t in set(terms_of(text)):
                if tf := w.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "Élan", "x1", "ß", "naïve", "日本"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([6, 20, 66])]) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    docs += [(None, "the w1 w2"), (None, "the w1 w2"), (3, None), (n + 1, ""), (n + 2, "..., !"), (7, docs[7][1]), (8, "THE w1-w2 élan ÉLAN"), ((1 << 60) + 1, "w1 w2 w3 the")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(12)]
    return docs, items + [(90, None), (91, "..."), (92, "absent"), (None, "the w1"), (93, "W1 w1 w1"), (93, "W1 w1 w1"), (93, "w2")]


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 300)])
def test_top_documents_equal_brute_force(spark, seed, n):
    docs, items = corpus(seed, n)
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    assert sorted((tuple(r) for r in top_documents(table, asked).collect()), key=str) == brute(docs, items)


def test_sets_of_items_and_small_blocks(spark, monkeypatch):
    docs, items = corpus(3, 120)
    monkeypatch.setattr(ranked_search, "PAIRS", 20)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in top_documents(table, asked).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert top_documents(docs, items).count() == 0
    assert top_documents(docs, some).count() == 0
    assert top_documents(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


def _block(n, hot):
    known = Terms(["rare", "hot"])
    sizes = [2 if i < 20 else 1 for i in range(n)]
    number = [x for i in range(n) for x in ([known.number["rare"]] if i < 20 else []) + [known.number["hot"]]]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(x, np.int32))) for x in (number, [1] * len(number))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([10] * n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
    weights = np.zeros(2, np.int64)
    weights[known.number["rare"]], weights[known.number["hot"]] = 5000, hot
    return Block(batch, weights, n, 10 * n), weights


def test_a_list_is_read_as_deep_as_the_threshold_asks():
    """Twenty documents with both terms beat all others, so the frequent term's list is left early; equal scores don't end the search before the least ids are in."""
    block, weights = _block(5000, 10)
    best = _Best()
    read = block.search(np.array([0, 1]), weights, best, np.zeros(2, np.int64))
    assert best.doc.tolist() == list(range(10)) and read < 500
    again = block.search(np.array([0, 1]), weights, best, np.zeros(2, np.int64))
    assert again < 500  # the floor of earlier blocks holds in later ones
    ties, weights = _block(5000, 5000)
    best = _Best()
    ties.search(np.array([1]), weights, best, np.zeros(2, np.int64))
    assert best.doc.tolist() == list(range(10))

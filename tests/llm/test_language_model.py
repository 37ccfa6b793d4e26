import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palim.llm import language_model as op
from palim.llm.common import held_out
from palim.llm.elias_fano import EliasFano
from tests.llm.helpers import awkward, documents, empty, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.lists(st.integers(0, 6000), min_size=1, max_size=50))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    ef = EliasFano.build(v, 5001)
    assert ef.access(np.arange(len(v))).tolist() == v.tolist()
    q = np.minimum(np.array(asked, np.uint64), np.uint64(5000))
    if len(v):
        assert ef.successor(q).tolist() == np.searchsorted(v, q).tolist()
        assert [i >= 0 for i in ef.find(np.array(asked, np.uint64))] == [a in set(values) for a in asked]


def test_elias_fano_large_values():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2))
    ef = EliasFano.build(v, 1 << 64)
    assert (ef.access(np.arange(len(v))) == v).all()
    assert (ef.find(v) == np.searchsorted(v, v)).all()
    assert (ef.find(v + np.uint64(1)) == -1).all()


def test_levels_survive_mapping(tmp_path):
    word = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 50, np.uint64))
    pairs = [(w, b) for w in word for b in range(0, 40, 7)]
    trie = op.Trie.build(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.uint64), np.arange(50), np.arange(len(pairs)) % 256)
    path = tmp_path / "t.ef"
    path.write_bytes(trie.to_bytes())
    mapped = op._open(f"file://{path}")
    at, count = mapped.look_up(word)
    assert at.tolist() == count.tolist() == list(range(50))
    ranks = mapped.ranks(np.array([7, 14, 15], np.uint64))
    assert ranks.tolist() == [1, 2, -1]
    gains = mapped.gains(at, np.array([0, 3, 3]), ranks)
    assert gains.tolist() == pytest.approx([1 * op.STEP, 20 * op.STEP, 0])


def brute(rows: list, weight: float | None = None):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    toks = {d: WORD.findall((t or "").encode().translate(low)) + [None] for d, t in rows}
    train = [d for d in toks if zlib.crc32(str(d).encode()) % 7 != 2]
    c, pairs, before = Counter(), Counter(), Counter()
    for d in train:
        c.update(toks[d])
        pairs.update(zip(["<"] + toks[d][:-1], toks[d]))
        before.update(["<"] + toks[d][:-1])
    n, v = sum(c.values()), len(c)
    if weight is None:
        def left_out(k):
            return sum(m * math.log((m - 1 + k * c[w] / (n + v)) / (before[a] - 1 + k)) for (a, w), m in pairs.items())

        return max(op.WEIGHTS.tolist(), key=left_out)
    out = {}
    for d, t in toks.items():
        p1 = [(c[w] + 1) / (n + v + 1) for w in t]
        score = sum(math.log10((pairs[a, w] + weight * p) / (before[a] + weight)) for a, w, p in zip(["<"] + t[:-1], t, p1))
        out[d] = (d not in train, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p1)), score)
    return out


def test_scores_match_brute_force(spark):
    texts = [prose(i % 40, 30 + i) for i in range(150)] + ["", None, "New Words Only", "ALPHA1 alpha1"]
    docs = documents(spark, texts)
    rows = list(enumerate(texts))
    model = op.train(docs.filter(~held_out(7, 2)))
    assert model.weight == brute(rows)  # training rows alone choose it
    want = brute(rows, model.weight)
    got = {r["doc_id"]: tuple(r)[1:] for r in op.score(docs, model).collect()}
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4]
        assert got[d][4] == pytest.approx(w[4], abs=1e-9)
        assert got[d][5] == pytest.approx(w[5], abs=op.STEP * w[1])


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = op.train(docs)
    got = op.score(docs, model)
    assert got.count() == docs.count()
    assert got.filter("doc_id = 60").first()["n_tokens"] == 1
    assert got.filter("doc_id IS NULL").count() == 1
    assert op.score(empty(spark), model).count() == 0
    nothing = op.score(docs, op.train(empty(spark)))
    assert {r["score"] for r in nothing.collect()} == {0.0}


def test_words_that_differ_are_told_apart(spark):
    from tests.llm.test_substring_dedup import thue_morse

    train = documents(spark, [thue_morse(2048), "other words"])
    got = op.score(documents(spark, [thue_morse(2048, True), thue_morse(2048)]), op.train(train)).orderBy("doc_id").collect()
    assert [r["n_known"] for r in got] == [1, 2]


@pytest.mark.parametrize("hot", [op.HOT, 4])
def test_an_unseen_pair_never_looks_seen(spark, monkeypatch, hot):
    """One word after thousands of others: pairs that the training texts lack gain nothing, those they hold do. Also with few frequent words."""
    monkeypatch.setattr(op, "HOT", hot)
    texts = [" ".join(f"a{i} the" for i in range(j * 500, j * 500 + 500)) for j in range(8)] + [" ".join(f"b{i} end" for i in range(3000))]
    docs = documents(spark, texts * 3)
    model = op.train(docs)
    asked = documents(spark, ["b7 the", "a7 the", "b2999 the", "a3999 the"])
    r = [x["score"] - x["base_score"] for x in op.score(asked, model).orderBy("doc_id").collect()]
    assert r[1] > r[0] + 0.2 and r[3] > r[2] + 0.2


def test_count_codes():
    counts = np.concatenate((np.arange(1, 5000), 2 ** np.arange(13, 34)))
    back = op._COUNTS[op.count_code(counts)]
    assert (back[:128] == counts[:128]).all()
    assert (np.abs(np.log10(back / counts))[counts <= 4096] < 0.01).all() and (np.abs(np.log10(back / counts)) < 0.08).all()


def test_codes_reach_the_largest_term():
    """With 10^13 tokens a pair of rare words is still within half a step."""
    model = op.Model("file:///x", 1, 10**13, 10**9, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    model.weight = 256.0
    for c in (1, 2, 50, 10**6):
        counts = np.array([c]), np.array([c])
        assert abs(float(model.quantised(*counts)[0]) * model.step - model.gain(*counts)[0]) <= model.step / 2 + 1e-9
    small = op.Model("file:///x", 1, 10**6, 10**4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    small.weight = 256.0
    assert small.step == op.STEP


def test_a_missing_trie_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT", 1)  # else broadcast counts answer for so few words
    model = op.train(documents(spark, [prose(i, 60) for i in range(30)]))
    others = documents(spark, [prose(i, 60) for i in range(1000, 1030)])
    assert len(op.score(others, model).collect()) == 30
    for shard in np.flatnonzero(model.built):
        os.remove(model.path(int(shard), True).removeprefix("file://"))
    with pytest.raises(Exception, match="No such file"):
        op.score(others, model).collect()


def test_a_folder_without_a_scheme_is_qualified(spark):
    from palim.llm.common import shared_folder

    assert shared_folder(spark).startswith("file:///")

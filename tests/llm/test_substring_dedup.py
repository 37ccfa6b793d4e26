import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palim.llm import substring_dedup as op
from tests.llm.helpers import awkward, documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_a_window_has_the_same_key_wherever_it_stands(core, a, b, c, d):
    """Also within runs and at the ends of documents."""
    names = np.random.default_rng(2).integers(0, 1 << 63, 4, np.uint64)
    words = names[np.array(a + core + b + c + core + d)]
    doc = np.array([0] * (len(a) + 13 + len(b)) + [1] * (len(c) + 13 + len(d)))
    first, key, short = op.windows(words, doc)
    at = {int(f): i for i, f in enumerate(first)}
    i, j = at[len(a)], at[len(a) + 13 + len(b) + len(c)]
    assert (key[i], short[i]) == (key[j], short[j])


def brute(rows):
    first = {}
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in sorted(docs, key=lambda x: x[0]):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("block", [op.BLOCK, 3000])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    shared, line = prose(77, 60), prose(78, 14)
    texts = []
    for i in range(80):
        t = prose(i, 40)
        if i % 4 == 0:
            t += " " + shared[i : i + 300]
        if i % 3 == 0:
            t = f"{line}\n{t}"
        if i % 10 == 0:
            t += " spam" * 40
        texts.append(t)
    texts += [texts[5], texts[5] + " more", "", None, prose(3, 12), prose(3, 13)]
    want = brute(enumerate(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in op.remove_repeats(documents(spark, texts).repartition(5)).collect()}
    assert got == want


def test_frequent_keys_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(op, "OFTEN", 2)
    monkeypatch.setattr(op, "HOT", 10_000)
    texts = [f"{prose(5, 30)} {prose(i, 20)}" for i in range(40)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in op.remove_repeats(documents(spark, texts)).collect()}
    assert got == brute(enumerate(texts))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = op.remove_repeats(docs, ("score", "kept")[:1])
    assert got.count() == docs.count()
    assert got.filter("doc_id = 60 AND n_words = 0 AND kept = ''").count() == 1
    assert got.filter("doc_id = 4 AND n_removed > 0").count() == 0  # its copies have the same id
    assert got.filter("doc_id = 65 AND n_removed = n_words").count() == 1
    assert op.remove_repeats(empty(spark)).count() == 0


def thue_morse(n, swap=False):
    """Words that collide under any sum of bytes times powers modulo 2**64, whatever the factors."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_differ_are_told_apart(spark):
    shared = prose(5, 12).split()
    texts = [" ".join([*shared[:6], thue_morse(2048), *shared[6:]]), " ".join([*shared[:6], thue_morse(2048, True), *shared[6:]])]
    assert brute(enumerate(texts))[1][1] == 0
    assert [r["n_removed"] for r in op.remove_repeats(documents(spark, texts)).orderBy("doc_id").collect()] == [0, 0]


def test_one_text_with_a_very_frequent_key(spark):
    """A header that one document repeats 70,000 times, each time before another word: all those windows have one key."""
    header = " ".join(prose(6, 9).split())
    texts = ["short " + prose(1, 30), " ".join(f"{header} n{i}" for i in range(70_000)), f"{prose(2, 20)} {header} n3 {header} n4 {prose(3, 20)}"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in op.remove_repeats(documents(spark, texts)).collect()}
    assert got == brute(enumerate(texts))


def test_columns_may_have_any_name(spark):
    docs = documents(spark, [prose(1, 30), prose(1, 30)]).selectExpr("*", "'a' AS bucket", "'b' AS kind", "doc_id AS windows")
    got = op.remove_repeats(docs, ("bucket", "kind", "windows", "text")).orderBy("doc_id").collect()
    assert [(r["bucket"], r["kind"], r["windows"], r["n_removed"]) for r in got] == [("a", "b", 0, 0), ("a", "b", 1, 30)]


def test_rows_between_tasks_follow_the_text(spark, monkeypatch):
    """Twice the shards don't make twice the rows: blocks grow with them."""
    from palim.llm.common import block_bytes

    assert all(block_bytes(n) / n >= 1024 for n in (64, 1024, 8192, 16384))
    docs = documents(spark, [prose(i, 200) for i in range(200)]).coalesce(1)
    rows = []
    for n in (4, 8):
        monkeypatch.setattr(op, "SHARD_WINDOWS", 40_000 // n)
        rows.append(op.repeated_windows(docs, 8).count())
    assert rows[1] <= rows[0] + 8


def test_payload_follows_the_text_whatever_the_shards():
    """Hashed ids and short texts: a block names to a shard just the documents that have something there."""
    batch = pa.RecordBatch.from_arrays([pa.array([hash((i, "id")) & (1 << 62) - 1 for i in range(6000)], pa.int64()), pa.array([prose(i, 14) for i in range(6000)])], ["doc_id", "text"])
    known, key, whole, rank = op._block_windows(batch)
    order, bounds = op._by_key(key, rank)
    none, sizes = np.zeros(0, np.int64), []
    for shards in (8, 200):
        cut = np.searchsorted(op.range_shard(key[order][bounds[:-1]], shards), np.arange(shards + 1))
        groups = [bounds[a : z + 1] for a, z in zip(cut[:-1], cut[1:]) if z > a]
        sizes.append(sum(len(op._payload(known, key[order[g[:-1]]], rank[order[g[:-1]]], np.diff(g), whole[order[g[0] : g[-1]]], none, none.astype(np.uint64), none)) for g in groups))
    assert sizes[1] < 1.5 * sizes[0]

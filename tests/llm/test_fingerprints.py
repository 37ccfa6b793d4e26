import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from palim.llm import syncmers as op
from palim.llm.common import utf8
from tests.llm.helpers import awkward, documents, empty, prose


def brute_anchors(text: bytes) -> list[int]:
    """Starts of closed syncmers, one k-mer at a time."""
    if len(text) < op.K:
        return [0] if text else []
    words = np.array([int.from_bytes(text[i : i + op.S], "little") for i in range(len(text) - op.S + 1)], np.uint64)
    h = op.mix(words * np.uint64(0x9E3779B97F4A7C15))
    w = op.K - op.S + 1
    return [i for i in range(len(text) - op.K + 1) if min(h[i : i + w]) in (h[i], h[i + w - 1])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_anchors_match_brute_force(texts):
    data, off = utf8(pa.array(texts))
    start, _, doc = op.anchors(data, off)
    for i, t in enumerate(texts):
        assert (start[doc == i] - off[i]).tolist() == brute_anchors(t.encode())


def test_anchors_are_context_free():
    core = prose(1, 60)
    a, b = (f"{x} {core} {y}" for x, y in (("left", "right"), ("quite another beginning of it", "and an end")))
    data, off = utf8(pa.array([a, b]))
    _, h, d = op.anchors(data, off)
    inner, ioff = utf8(pa.array([core]))
    _, want, _ = op.anchors(inner, ioff)
    assert set(want.tolist()) <= set(h[d == 0].tolist()) & set(h[d == 1].tolist())


def test_edited_text_and_likeness(spark):
    texts = [prose(i, 200) for i in range(9)] + ["", "ab", None, prose(0, 200)]
    got = {r["doc_id"]: r for r in op.edited_fingerprints(documents(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        half, following = len(t) // 2, plain[(i + 1) % len(plain)]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[12]["fingerprint"] != got[1]["fingerprint"]
    assert 0.15 < got[0]["near_edited"] < 0.6
    assert got[0]["near_next"] < 0.1
    assert got[12]["near_next"] == 1.0  # the next of the last is the first
    assert got[9]["fingerprint"] == ""


def test_across_many_ranges(spark):
    texts = [prose(i, 30) for i in range(300)]
    got = {r["doc_id"]: r["edited_sha256"] for r in op.edited_fingerprints(documents(spark, texts).repartition(7)).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + texts[(i + 1) % 300][:half]).encode()).hexdigest()


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert op.edited_fingerprints(docs).count() == docs.count()
    assert op.fingerprints(docs).count() == docs.count()
    assert op.edited_fingerprints(empty(spark)).count() == 0
    one = op.edited_fingerprints(documents(spark, ["only this text of some length"])).first()
    assert one["near_next"] == 1.0
    assert op.positions(docs).filter("doc_id = 1").count() > 5


def test_texts_without_a_syncmer_have_their_own_fingerprint():
    bare = [t for i in range(400) if not brute_anchors((t := prose(i, 9)[: 24 + i % 15]).encode())]
    assert len(set(bare)) > 20
    own = op.sketches(*utf8(pa.array([*bare, ""])))
    hexes = op.as_text(own)
    assert hexes[-1] == "" and len(set(hexes[:-1])) == len(set(bare)) and "" not in hexes[:-1]
    other = np.array([next(j for j, u in enumerate(bare) if u != t) for t in bare] + [0])
    assert op.likeness(own, own, np.arange(len(bare) + 1), other).max() == 0
    assert op.likeness(own, own, np.array([len(bare)]), np.array([len(bare)])).tolist() == [1.0]


def test_large_ids_beside_a_null_id(spark):
    """Ids over 2^53 stay whole numbers: each row comes out once, in the order of ids."""
    rows = [((1 << 60) + i, prose(i, 10)) for i in range(400)] + [(None, "no id")]
    out = op.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"]) for r in out), key=str) == sorted(((i is not None, i) for i, _ in rows), key=str)
    texts = dict(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] + 1 in texts:
            t, following = texts[r["doc_id"]], texts[r["doc_id"] + 1]
            edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

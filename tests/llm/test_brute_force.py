"""Whole queries against their definitions: in SQL for the columns that SQL can express, in plain Python for the rest."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from palim.llm import language, near_dedup, quality, queries, sharding, syncmers, toxicity
from palim.llm.common import mix, utf8
from tests.llm.helpers import documents, prose
from tests.llm.test_near_dedup import brute_components


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    ids = [r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()]
    con.register("crc", pa.table({"doc_id": ids, "crc": [zlib.crc32(str(i).encode()) for i in ids]}))
    return con


def _rows(spark, sf_dir, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(*columns).collect())


def test_op1_lengths_and_edited_texts(spark, sf_dir, db):
    want = db.sql(
        """SELECT doc_id, CAST(length(t) AS BIGINT), sha256(left(t, length(t) - length(t) // 2) || left(coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)), length(t) // 2))
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) ORDER BY doc_id"""
    ).fetchall()
    assert _rows(spark, sf_dir, "op1_syncmer_fingerprints", "doc_id", "n_chars", "edited_sha256") == want


def test_op1_likeness(spark):
    """Least anchors of both texts, and the share of the least of both together that both have."""

    def sketch(text):
        raw = text.encode()
        k, s = syncmers.K, syncmers.S

        def h(i):
            return int(mix(np.array([int.from_bytes(raw[i : i + s], "little") * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0])

        starts = []
        for i in range(len(raw) - k + 1):
            inner = [h(j) for j in range(i, i + k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                starts.append(i)
        at, hashes, _ = syncmers.anchors(*utf8(pa.array([text])))
        assert sorted(at.tolist()) == starts  # the anchors are those of the definition; only their hashes are taken over
        return set(sorted({int(x) >> 32 for x in hashes})[: syncmers.SKETCH])

    def like(a, b):
        low = sorted(a | b)[: syncmers.SKETCH]
        return sum(x in a and x in b for x in low) / len(low)

    texts = [prose(i, 60 + 10 * i) for i in range(4)] + [prose(2, 80)]
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert got[i]["near_next"] == pytest.approx(like(sketch(t), sketch(following)))
        kept = len(t[: len(t) - half].encode())
        assert kept - 120 < got[i]["same_until"] <= kept + len(os.path.commonprefix([t[len(t) - half :], following]).encode()) + syncmers.K
        assert got[i]["near_edited"] == pytest.approx(like(sketch(t), sketch(t[: len(t) - half] + following[:half])))


def test_op6_counts_and_base_scores(spark, sf_dir, db):
    want = db.sql(
        r"""WITH words AS (SELECT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS w FROM documents),
        train AS (SELECT w, count(*) AS c FROM words JOIN crc USING (doc_id) WHERE crc % 7 <> 2 GROUP BY 1), whole AS (SELECT sum(c) AS n, count(*) AS v FROM train)
        SELECT doc_id, any_value(crc) % 7 = 2 AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
        FROM words JOIN crc USING (doc_id) LEFT JOIN train USING (w), whole GROUP BY 1 ORDER BY 1"""
    ).fetchall()
    got = _rows(spark, sf_dir, "op6_elias_fano_lm", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def test_op9_sizes_and_slots(spark, sf_dir, db):
    got = _rows(spark, sf_dir, "op9_kd_sharding", "doc_id", "size", "text_crc32", "shard", "slot")
    texts = dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    assert [r[:3] for r in got] == [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in sorted(texts.items())]
    for s in range(8):
        assert sorted(r[4] for r in got if r[3] == s) == list(range(sum(r[3] == s for r in got)))
    loads = np.bincount([r[3] for r in got], [r[1] for r in got], minlength=8)
    assert loads.max() < 1.1 * loads.min()


def brute_shards(rows, shards, first=0, tolerance=0.02, spread=None):
    """rows: (id, weight, dims). Splits at the weighted median of the widest dimension that comes within the tolerance."""
    if shards == 1:
        return {r[0]: first for r in rows}
    n_dims = len(rows[0][2])
    low, high = ([f(r[2][d] for r in rows) for d in range(n_dims)] for f in (min, max))
    spread = spread or [max(1, high[d] - low[d]) for d in range(n_dims)]
    total = sum(r[1] for r in rows)
    due = total * (shards // 2) / shards
    for d in sorted((d for d in range(n_dims) if high[d] > low[d]), key=lambda d: -(high[d] - low[d]) / spread[d]):
        below, cut = 0, None
        for value in sorted({r[2][d] for r in rows}):
            here = sum(r[1] for r in rows if r[2][d] == value)
            if below + here >= due:
                cut, error = (value - 1, due - below) if due - below < below + here - due else (value, below + here - due)
                break
            below += here
        if error <= tolerance * total:
            left, right = [r for r in rows if r[2][d] <= cut], [r for r in rows if r[2][d] > cut]
            return brute_shards(left, shards // 2, first, tolerance, spread) | brute_shards(right, shards - shards // 2, first + shards // 2, tolerance, spread)
    raise AssertionError("no cut within the tolerance")


def test_op9_cuts(spark):
    texts = [prose(i, 5 + i * 13 % 80) + "\n" * (i % 7) for i in range(1200)]
    rows = [(i, len(t.encode()) + 1, (len(t.encode()) + 1, len(t), t.count("\n") + 1, zlib.crc32(t.encode()))) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(documents(spark, texts), 4).collect()}
    assert got == brute_shards(rows, 4)


def test_op10_whole_query(spark, sf_dir, db):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    texts = db.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    prints = [fingerprint(t) for _, t in texts]
    root = brute_components(prints, 4)
    want = [(i, f"{p:016x}", texts[r][0]) for (i, _), p, r in zip(texts, prints, root)]
    assert _rows(spark, sf_dir, "op10_simhash_bk_tree", "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("parts", [6, 7, 8])
def test_op10_links_by_more_parts(spark, parts):
    rng = np.random.default_rng(parts)
    prints = set()
    for c in rng.integers(0, 1 << 62, 30, np.uint64):
        for _ in range(6):
            x = int(c)
            for b in rng.integers(0, 62, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    roots = {r["node"]: r["root"] for r in near_dedup.components(near_dedup.links(spark.createDataFrame([(p,) for p in prints], "print long"), 4, parts)).collect()}
    assert [roots.get(p, p) for p in prints] == [prints[r] for r in brute_components(prints, 4)]


def test_parts_follow_the_number_of_fingerprints():
    assert [near_dedup.parts_for(n, 4) for n in (10, 10**9, 10**10, 5 * 10**10, 10**12)] == [6, 6, 7, 7, 8]


# Classifiers: the rule of each, by loops.


def test_op2_votes_of_pairs():
    rng = np.random.default_rng(0)
    model = language.LanguageModel(["f", "g"], {"f": ["a", "b", "c"], "g": ["d"]}, rng.normal(size=(6, 2)).astype(np.float32))
    model.duels = {p: rng.normal(size=6).astype(np.float32) for p in (("a", "b"), ("a", "c"), ("b", "c"))}
    x = rng.normal(size=(40, 5)).astype(np.float32)
    got, scores = model.predict(x)
    for row, lang, score in zip(x, got, scores):
        v = np.append(row, 1.0)
        family = v @ model.family_weights
        p = np.exp(family) / np.exp(family).sum()
        if family[1] > family[0]:
            assert lang == "d" and score == pytest.approx(p[1], rel=1e-4)
            continue
        won = {n: 0.0 for n in "abc"}
        least = {n: 1.0 for n in "abc"}
        for (a, b), w in model.duels.items():
            q = 1 / (1 + math.exp(-3 * float(v @ w)))
            for n, share in ((a, q), (b, 1 - q)):
                won[n] += (share >= 0.5) + share * 1e-3
                least[n] = min(least[n], share)
        best = max(won, key=won.get)
        assert lang == best and score == pytest.approx(p[0] * least[best], rel=1e-3)


def test_op2_machine_is_the_minimum():
    """No small step from the found weights lowers the squared hinge loss with its ridge."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w):
        return 0.5 * w @ w + 30 * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = language._machine(x, y).astype(float)
    steps = [d * e for d in (1e-2, -1e-2) for e in np.eye(4)]
    assert all(loss(w) <= loss(w + s) + 1e-6 for s in steps)


def test_op3_score_is_the_mean_of_its_ngrams(spark):
    rng = np.random.default_rng(2)
    model = np.append(rng.normal(size=quality.BUCKETS) * 3, 0.4).astype(np.float32)
    texts = [prose(i, 3 + i * 7) for i in range(8)] + ["same same same", "", "é ü"]
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        bucket, _ = quality.ngrams(*utf8(pa.array([t])))
        raw, n_words = t.encode(), len(t.split())
        assert len(bucket) == n_words + max(0, n_words - 1) + max(0, len(raw) - 2) + max(0, len(raw) - 4)  # words, pairs, byte 3- and 5-grams
        z = (sum(float(model[b]) for b in bucket) / max(1, len(bucket))) + float(model[-1])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_op3_learns_by_gradient(spark):
    """One document a class with its own bucket: odds of the first fall, those of the second rise, others stay near nothing."""
    rows = [(0, np.array([5], np.uint16), np.array([2], np.uint32)), (1, np.array([9], np.uint16), np.array([1], np.uint32))] * 40
    odds = quality.fit(rows)
    assert odds[5] < -1 and odds[9] > 1 and np.abs(np.delete(odds[:-1], [5, 9])).max() < 1


def test_op5_best_split_and_steps():
    rng = np.random.default_rng(3)
    binned = rng.integers(0, toxicity.BINS, (300, 4))
    g, h = rng.normal(size=300), rng.uniform(0.1, 0.3, 300)
    g += np.where(binned[:, 2] > 11, 0.8, -0.8)

    def gain(f, c):
        left = binned[:, f] <= c
        if min(left.sum(), (~left).sum()) < toxicity.LEAST_LEAF:
            return 0.0
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    best = max(((f, c) for f in range(4) for c in range(toxicity.BINS)), key=lambda x: gain(*x))
    tree = toxicity._grow(binned, g, h)
    assert tree[0][:2] == best
    for k, (feature, _, value) in enumerate(tree):  # a leaf has the Newton step of its rows
        if feature < 0 and value:
            node = np.zeros(300, int)
            for _ in range(toxicity.DEPTH):
                f = np.array([t[0] for t in tree])[node]
                c = np.array([t[1] for t in tree])[node]
                node = np.where(f < 0, node, 2 * node + 1 + (binned[np.arange(300), np.maximum(f, 0)] > c))
            rows = node == k
            if rows.any():
                assert value == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1))


def test_op5_isotonic_is_the_nearest_rising_fit():
    """Of all ways to cut the points into runs whose means rise, the one with the least squares."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        y, w = rng.integers(0, 2, 7).astype(float), rng.uniform(0.5, 2, 7)
        best = None
        for cuts in range(1 << 6):
            bounds = [0, *(i + 1 for i in range(6) if cuts >> i & 1), 7]
            means = [np.average(y[a:z], weights=w[a:z]) for a, z in zip(bounds[:-1], bounds[1:])]
            if all(a <= b for a, b in zip(means, means[1:])):
                error = sum((w[a:z] * (y[a:z] - m) ** 2).sum() for a, z, m in zip(bounds[:-1], bounds[1:], means))
                best = min(best, error) if best is not None else error
        _, levels = toxicity.isotonic(np.arange(7.0), y, w)
        pools, at = [], 0
        for level in levels:  # the pools, by their means
            z = next(z for z in range(at + 1, 8) if np.average(y[at:z], weights=w[at:z]) == pytest.approx(level) and (z == 7 or len(pools) + 1 < len(levels)) and _rest_fits(y, w, levels, len(pools) + 1, z))
            pools.append((at, z))
            at = z
        assert sum((w[a:z] * (y[a:z] - lv) ** 2).sum() for (a, z), lv in zip(pools, levels)) == pytest.approx(best) and at == 7


def _rest_fits(y, w, levels, k, at):
    if k == len(levels):
        return at == len(y)
    return any(np.average(y[at:z], weights=w[at:z]) == pytest.approx(levels[k]) and _rest_fits(y, w, levels, k + 1, z) for z in range(at + 1, len(y) + 1))


def test_op5_calibration_rows_teach_neither_lexicon_nor_trees(spark, monkeypatch):
    """A word that only toxic calibration rows have isn't in the lexicon."""
    docs = documents(spark, [prose(i, 30) for i in range(600)])
    ids = [r["doc_id"] for r in docs.filter(toxicity.for_calibration()).collect()]
    texts = [f"{prose(i, 30)} {'grobnak ' * 3 if i in set(ids) and i % 2 else 'wurzix ' * 3 if i % 2 else ''}" for i in range(600)]
    model = toxicity.train(documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int"))
    word = lambda w: bool(np.isin(toxicity.word_hashes(w), model.lexicon)[0])
    assert word("wurzix") and not word("grobnak")

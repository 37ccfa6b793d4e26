import duckdb
import numpy as np
import pytest

from palim.operators import cells, similarity_join
from palim.operators.similarity_join import above, axes, pairs_above


def clustered(seed, n, d=24, centres=12, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d)) * np.linalg.norm(c, axis=1).mean() / np.sqrt(d)
    return v / np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(0.5, 1.5, (n, 1))


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.9, 1.4])
def test_no_pair_is_lost(threshold):
    v = clustered(1, 300)
    i, j, made, finished = pairs_above(v[:120], v, threshold, axes(v))
    x, y = np.nonzero(v[:120] @ v.T > threshold)
    assert set(zip(x, y)) <= set(zip(i, j))
    assert made <= 120 * 300 * 24 and finished <= 120 * 300


def test_near_copies_among_unlike_vectors_take_a_tenth_of_the_products():
    v = clustered(2, 600, d=64)
    _, _, made, finished = pairs_above(v, v, 2.0, axes(v))
    assert made < 0.15 * 600 * 600 * 64 and finished < 0.1 * 600 * 600


def test_the_drivers_vectors(sf_dir):
    """Unlike vectors without any axis of their own: few pairs are used to the last coordinate."""
    rows = duckdb.connect().execute(f"SELECT embedding FROM '{sf_dir.replace('0.001', '0.1')}/embeddings.parquet' LIMIT 600").fetchall()
    v = np.array([r[0] for r in rows], float)
    _, _, made, finished = pairs_above(v, v, 0.95, axes(v))
    assert made < 0.2 * v.shape[0] ** 2 * v.shape[1]
    assert pairs_above(v, v, 0.3, axes(v))[3] < 0.1 * v.shape[0] ** 2


def _rows(spark, v, name, key=lambda i: "k"):
    rows = [(key(i), i, [float(x) for x in u]) for i, u in enumerate(v)]
    return spark.createDataFrame(rows, f"k string, {name} long, vector array<double>")


@pytest.mark.parametrize("large", [1 << 14, 10])
def test_join_equals_all_products(spark, monkeypatch, large):
    """One key with nearly all rows, in cells and without; ragged, empty and null vectors; null keys; a member left out."""
    monkeypatch.setattr(similarity_join, "LARGE", large)
    monkeypatch.setattr(cells, "PROBES", 40)
    monkeypatch.setattr(cells, "MEMBERS", 60)
    v = clustered(3, 260)
    key = lambda i: "hot" if i < 240 else f"k{i % 3}"
    odd = spark.createDataFrame([("hot", 900, [1.0, 2.0]), ("hot", 901, []), ("hot", 902, None), (None, 903, [float(x) for x in v[0]])], "k string, member long, vector array<double>")
    members = _rows(spark, v, "member", key).unionByName(odd)
    probes = members.selectExpr("k", "member AS probe", "member AS exclude", "vector")
    got = {}
    for p, m, s in above(probes, members, "k", 3, 0.8).collect():
        assert m not in got.setdefault(p, {})
        got[p][m] = s
    for i in range(len(v)):
        scores = {j: float(v[i] @ v[j]) for j in range(len(v)) if j != i and key(i) == key(j) and v[i] @ v[j] > 0.8}
        best = sorted(scores, key=lambda j: (-scores[j], j))[:3]
        assert set(best) <= set(got.get(i, {}))
        assert all(abs(scores[m] - s) < 1e-9 for m, s in got.get(i, {}).items())
    assert set(got) <= {*range(len(v)), 900} and got.get(900, {}).keys() <= {900}


def test_far_groups_do_not_meet(spark, monkeypatch):
    """Clusters at right angles: rows are copied to their own group only, though one key has them all."""
    monkeypatch.setattr(similarity_join, "LARGE", 10)
    rng = np.random.default_rng(4)
    v = np.eye(32)[rng.integers(0, 32, 600)] + 0.02 * rng.normal(size=(600, 32))
    members = _rows(spark, v, "member")
    placed = similarity_join._placed(members.selectExpr("k", "member", "vector", "true AS large"), np.eye(32))
    pairs = similarity_join.meeting(similarity_join._stats(placed, "k", 512, "a"), similarity_join._stats(placed, "k", 4096, "b"), np.eye(32), 0.9)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(i, i) for i in range(32)]
    work = spark.sparkContext.accumulator(0)
    probes = members.selectExpr("k", "member AS probe", "member AS exclude", "vector")
    found = above(probes, members, "k", 1000, 0.9, work).count()
    assert found == int((v @ v.T > 0.9).sum()) - int((np.einsum("ij,ij->i", v, v) > 0.9).sum())
    assert work.value < 0.1 * 600 * 600 * 32


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string, member long, vector array<double>")
    probes = none.selectExpr("k", "member AS probe", "member AS exclude", "vector")
    assert above(probes, none, "k", 5, 0.5).count() == 0
    assert above(probes, _rows(spark, clustered(5, 5), "member"), "k", 5, 0.5).count() == 0


def test_links_stay_when_groups_meet():
    """A link between two elements with one root holds when one of them later gets a lesser root."""
    rng = np.random.default_rng(4)
    assert similarity_join._roots(21, np.array([5, 9, 20]), np.array([9, 20, 2]))[[2, 5, 9, 20]].tolist() == [2, 2, 2, 2]
    for n, links in ((40, 30), (300, 280), (300, 900)):
        a, b = rng.integers(0, n, links), rng.integers(0, n, links)
        got = similarity_join._roots(n, a, b)
        assert all(got[x] == got[y] for x, y in zip(a, b))

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palim.llm import near_dedup as op
from palim.llm.bk_tree import Forest
from tests.llm.helpers import awkward, documents, empty, prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255)), min_size=1, max_size=60, unique=True), st.integers(0, 4))
def test_forest_finds_all_within_radius(rows, radius):
    rows = sorted(rows)
    groups = np.unique([g for g, _ in rows], return_inverse=True)[1]
    prints = np.array([p * 0x0101010101010101 for _, p in rows], np.uint64)
    forest = Forest(prints, groups)
    found = {(int(a), int(b)) for q, n in forest.within(prints, groups, radius * 8) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if groups[i] == groups[j] and int(prints[i] ^ prints[j]).bit_count() <= radius * 8}
    assert found == want


def test_fingerprint_by_definition():
    text = "The quick  brown\tfox jumps over the lazy DOG the quick brown fox"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert op.fingerprint(text.encode(), 4) == want
    assert op.fingerprint(b"two Words", 4) == xxhash.xxh64_intdigest("two words", 42)
    assert op.fingerprint(b" \t ", 4) == 0


def brute_components(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def _links(spark, prints, monkeypatch=None):
    df = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints], "print long")
    return {(r["a"], r["b"]) for r in op.links(df).collect()}


def test_links_connect_whatever_is_near(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 20, np.uint64)
    prints = set()
    for c in centres:
        for _ in range(30):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >= 1 << 63 else p)
    want = brute_components(prints, 4)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    for tree in (2048, 7):  # small groups, then groups split into many trees
        monkeypatch.setattr(op, "TREE", tree)
        df = spark.createDataFrame([(p,) for p in signed], "print long")
        roots = {r["node"]: r["root"] for r in op.components(op.links(df)).collect()}
        assert [roots.get(p, p) for p in signed] == [signed[w] for w in want]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in op.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 100 for i in range(100, 160))
    assert got[201] == got[200] == 200
    assert op.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = prose(1, 400)
    texts = [prose(9, 50), base, base.upper(), base.replace(" ", "  "), prose(2, 100), "", None, "one", "One"]
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(documents(spark, texts)).collect()}
    assert got[2] == got[3] == got[1] == 1
    assert got[5] == got[6] == 5
    assert got[7] == got[8] == 7
    assert got[0] == 0
    assert got[4] == 4


def test_similar_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(12):
        words = prose(i, 150).split()
        for edits in (0, 1, 3, 6, 12):
            w = list(words)
            for j in rng.integers(0, 150, edits):
                w[j] = f"new{j}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in op.similar_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = op.near_duplicates(docs)
    assert got.count() == docs.count()
    assert got.filter("doc_id IS NULL").first()["component_id"] is None
    assert op.near_duplicates(empty(spark)).count() == 0
    groups = op.similar_groups(docs)
    assert groups.count() == docs.filter("doc_id IS NOT NULL").count()
    assert op.similar_groups(empty(spark)).count() == 0


def test_links_of_long_texts_are_exact(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(24):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
        other = list(words)
        for j in range(13 + i % 2):  # 0.803 or 0.790
            other[10 + 40 * j] = f"new{i}x{j}"
        texts += [" ".join(words), " ".join(other)]
    words = " ".join(texts[0].split()[::-1][:300])
    texts += [words, words + " and one more line of it" * 200]  # equal sets but for some shingles
    got = {r["doc_id"]: r["component_id"] for r in op.similar_groups(documents(spark, texts)).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(24)] == [i % 2 == 0 for i in range(24)]
    assert got[49] == 48


def test_large_groups_of_similar_texts_match_brute_force(spark, monkeypatch):
    """Groups many times larger than a tree: a dense cluster, and one that hangs together by a chain of links only."""
    monkeypatch.setattr(op, "TEXTS", 8)
    rng = np.random.default_rng(6)
    words, texts = prose(1, 120).split(), []
    for i in range(60):
        w = list(words)
        for j in rng.integers(60, 120, 1):
            w[j] = f"dense{i}"
        texts.append(" ".join(w))
    words = prose(2, 120).split()
    for i in range(40):  # each is near its neighbours, not near those farther off
        words[110 - 2 * i] = f"chain{i}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in op.similar_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_rows_of_a_dense_cluster_follow_its_members(spark, monkeypatch):
    monkeypatch.setattr(op, "TREE", 8)
    for n in (100, 400, 800):
        keyed = spark.createDataFrame([(0, 7, i) for i in range(n)], "choice int, key long, least long")
        groups = op._group_parts(keyed, op.TREE)
        rooted = spark.createDataFrame([(i, 0) for i in range(n - 3)], "node long, root long")  # three are not connected yet
        assert op._first_pass(keyed, groups, "least").count() <= 3 * n
        assert n <= op._second_pass(keyed, groups, "least", rooted).count() <= 3 * n


def test_all_short_pairs_are_linked(spark):
    """Nine words against their first eight: five shingles and four, similarity 0.8, wherever their fingerprints lie."""
    pairs = 20_000
    rows = [(2 * i + k, " ".join(f"w{x}" for x in range(9 * i, 9 * i + 9 - k))) for i in range(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = op.similar_groups(docs).filter("component_id = doc_id - doc_id % 2")
    assert found.count() == 2 * pairs

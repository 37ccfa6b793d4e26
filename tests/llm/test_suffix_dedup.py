import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from palim.llm import suffix_dedup as sd
from palim.llm.loser_tree import merge
from palim.llm.suffix_dedup import decode, encode, remove_repeats, rows_of, strings_of, suffixes
from tests.llm.helpers import awkward, empty, prose

BIG = int(np.iinfo(np.int64).max)


def brute(docs):
    """doc_id, n_bytes, n_removed, n_spans, kept of each row."""
    first = {}
    for i, text in docs:
        raw, i = (text or "").encode(), BIG if i is None else i
        for s in range(len(raw) - 49):
            w = raw[s : s + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in docs:
        raw, j = (text or "").encode(), BIG if i is None else i
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < j:
                gone[s : s + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def run(docs):
    return sorted(((*tuple(r)[:4], bytes(r["kept"])) for r in remove_repeats(docs).collect()), key=str)


def texts(seed, n=60):
    """Documents pieced together from shared and own passages, runs of one byte, and characters of several bytes."""
    rng = random.Random(seed)
    shared = [prose(1000 + k, rng.randint(4, 30)) for k in range(6)] + ["a" * 70, "ab" * 60, "ü" * 40, "日本語の文" * 9, "\x00" * 60]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared) if rng.random() < 0.5 else prose(seed * 100 + rng.randint(0, 10**6), rng.randint(1, 20))
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : rng.randint(a, len(p))])
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs = texts(seed)
    docs += [(60, docs[3][1]), (61, docs[3][1]), (5, docs[7][1]), (5, docs[5][1]), (None, docs[9][1]), (None, docs[2][1]), (62, None), (63, ""), (1 << 61, docs[4][1]), ((1 << 61) + 1, docs[4][1] + "x")]
    table = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kept string").repartition(7)
    assert run(table) == brute(docs)


def test_hot_seeds_and_small_steps(spark, monkeypatch):
    """Strings of seeds that are given out one by one, chunks and steps that end anywhere."""
    for name, value in (("HELD", 40), ("HOT", 2), ("GROUP", 30), ("_STRINGS", 50), ("_CHUNK", 64), ("BLOCK", 2000)):
        monkeypatch.setattr(sd, name, value)
    docs = texts(4, 80) + [(100 + i, f"{prose(i, 3)} the line that everybody has, at the end of it {prose(i + 50, 3)}") for i in range(40)]
    got = list(sd._settle(iter(_payloads(docs)), 4))
    assert any(b.column("one").null_count < b.num_rows for b in got)
    assert run(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def _block(docs):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs]), pa.array([hash(t) for _, t in docs], pa.int64())], ["doc_id", "text", "text_hash"])


def _payloads(docs, shards=1, size=10):
    for a in range(0, len(docs), size):
        for shard, x in sd._dealt(_block(docs[a : a + size]), shards, 4):
            if shard is not None:
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(x, pa.binary()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary()), *[pa.nulls(len(x), pa.int64())] * 5], sd._DEALT_NAMES)


def test_payload_follows_the_text_whatever_the_shards():
    """Hashed ids, short documents: with many shards a row names just the documents that its suffixes come from; what grows is what smaller rows compress less."""
    docs = [(hash((i, "id")) & (1 << 62) - 1, prose(i, 14)) for i in range(4000)]
    few, many = (sum(p.nbytes for p in _payloads(docs, n, 4000)) for n in (8, 200))
    assert many < 2 * few


def test_awkward_rows(spark):
    rows = awkward(spark)
    got = run(rows)
    assert got == brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert run(empty(spark)) == []


def test_every_string_hangs_on_one_suffix():
    docs = [t for _, t in texts(5)] + ["x" * 49, "y" * 50, "", "z" * 200]
    raw = [t.encode() for t in docs]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    seed, _, first, last = suffixes(data, off)
    starts = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)])
    assert sorted(starts.tolist()) == [s for a, z in zip(off[:-1], off[1:]) for s in range(a, z - 49)]
    row, offset, one, two = strings_of(rows_of(data, seed, first, last))
    where = {}
    whole = data.tobytes()
    for s, h in zip((first[row] + offset).tolist(), zip(one.tolist(), two.tolist())):
        assert where.setdefault(whole[s : s + 50], h) == h
    assert len(set(where.values())) == len(where)
    of = {int(s): int(a) - int(s) for a, f, l in zip(seed, first, last) for s in range(f, l + 1)}
    for same in itertools.groupby(sorted(of, key=lambda s: whole[s : s + 50]), key=lambda s: whole[s : s + 50]):
        assert len({of[s] for s in same[1]}) == 1  # equal strings hang on equal places


def test_front_coding_is_undone():
    raw = " ".join(prose(i % 7, 30) for i in range(40)).encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    seed, _, first, last = suffixes(data, off)
    rows = rows_of(data, seed, first, last)
    rows = np.unique(rows.view(f"S{sd._WIDTH}").ravel()).view(np.uint8).reshape(-1, sd._WIDTH)
    shared = np.minimum(sd._shared(rows), sd._WIDTH - 2).astype(np.uint8)
    tails, _ = encode(rows, shared)
    assert (decode(shared, rows[:, -2], rows[:, -1] - 1, tails) == rows).all()
    assert len(tails) == sum(int(r) + int(l) - 1 for r, l in rows[:, -2:]) - sum(min(int(c), int(r[-2])) + max(0, min(int(c) - sd.LENGTH, int(r[-1]) - 1)) for c, r in zip(shared, rows))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_merge(k):
    rng = random.Random(k)
    runs = []
    for _ in range(k):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(0, 40)))
        common = [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in itertools.pairwise(strings)]
        runs.append((strings, common[: len(strings)]))
    which, shares = merge(runs, 12)
    at, out = [0] * k, []
    for w in which:
        out.append(runs[w][0][at[w]])
        at[w] += 1
    assert out == sorted(s for strings, _ in runs for s in strings)
    assert shares == [0][: len(out)] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in itertools.pairwise(out)]


def test_a_known_prefix_is_not_compared_again():
    class Watched(bytes):
        read: list = []

        def __getitem__(self, i):
            if isinstance(i, slice):
                Watched.read.append(i.start or 0)
            return super().__getitem__(i)

    prefix = b"p" * 20
    runs = [([Watched(prefix + bytes([a, b])) for b in range(50)], [0] + [21] * 49) for a in range(4)]
    which, _ = merge(runs, 22)
    assert which == [a for a in range(4) for _ in range(50)]
    assert sum(r == 0 for r in Watched.read) == 6 and len(Watched.read) < 20  # the first matches only; then lengths decide


def test_kept_bytes_by_hand(spark):
    passage = "0123456789" * 6
    docs = [(1, f"one {passage} two"), (2, f"three {passage} four")]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == [(1, 68, 0, 0, docs[0][1].encode()), (2, 71, 63, 1, b"threfour")]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_shards_are_even():
    """Seeds are the least of many hashes; they are dealt out evenly nevertheless."""
    docs = [(i, prose(i, 60)) for i in range(600)]
    batch = _block(docs)
    sizes = [len(p) for shard, x in sd._keys(batch, 16, 4) if shard is not None for p in x]
    assert len(sizes) == 16 and max(sizes) < 1.5 * min(sizes)

"""Deduplication of byte strings by a distributed merge sort of suffixes.

A string of LENGTH bytes hangs on the least (by hash, then place) of its runs of SEED bytes, so that equal strings hang
on equal seeds. A suffix is what stands from a seed on, as far as the strings that hang on it reach, with the bytes before it behind.
First the hashes of seeds alone are exchanged: a suffix whose seed no other document has is told apart by it and goes no further.
Then each task sorts the other suffixes of a block of documents; the run is front-coded (bytes shared with the suffix before are left out) and
exchanged by seed. There the runs are combined by loser trees that never compare a known prefix again (loser_tree.py). Suffixes that are
equal share all their strings; among those with one seed the strings that hang on it are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.llm.common import blocks, discard, group_bounds, materialise, mix, pack, range_shard, unpack, utf8
from palim.llm.loser_tree import merge

LENGTH, SEED = 50, 16
#: Seeds in a string, and how far before its seed a string may begin.
_SEEDS = LENGTH - SEED + 1
_LEFT = LENGTH - SEED
#: A suffix as a row: LENGTH bytes from the seed on, _LEFT bytes from the first string's start up to the seed (zeros behind either), the bytes used of both (the second plus 1).
_WIDTH = LENGTH + _LEFT + 2
_COLUMNS = np.arange(LENGTH + _LEFT, dtype=np.uint8)

BLOCK, DOCS = 4 << 20, 60_000
#: Positions that are worked on at once.
_CHUNK = 1 << 19
#: Suffixes of a shard, and bytes of text for one of them, about.
SHARD_SUFFIXES, BYTES_EACH = 150_000, 20
#: Suffixes decoded at once; suffixes a task holds from which on seeds with over HOT of them are given to single strings.
GROUP, HELD, HOT = 50_000, 600_000, 10_000
#: Strings that are compared at once.
_STRINGS = 500_000
_NO_ID = int(np.iinfo(np.int64).max)
_ODD = np.uint64(0x9FB21C651E98DF25)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _spread(least: np.ndarray) -> np.ndarray:
    """Hashes that were chosen for being least, over the whole range again."""
    return mix(least ^ _ODD)


def suffixes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, its hash, and first and last start of the strings that hang on it; strings lie within a document."""
    found = []
    n = len(data)
    lanes = _lanes(data)
    for c in range(0, n - LENGTH + 1, _CHUNK):
        size = min(_CHUNK, n - LENGTH + 1 - c)
        m = size + _SEEDS - 1
        value = mix(mix(lanes[c : c + m]) * _ODD + lanes[c + 8 : c + 8 + m])
        hashes, place, d = value, np.arange(m, dtype=np.int32), 1
        while d < _SEEDS:
            d_ = min(d, _SEEDS - d)  # the last step overlaps: 32 and 32 make 35
            left = value[:-d_] <= value[d_:]
            value, place = np.where(left, value[:-d_], value[d_:]), np.where(left, place[:-d_], place[d_:])
            d += d_
        inside = np.zeros(size + 1, np.int32)  # over 0: a document ends before the string does
        ends = off[np.searchsorted(off, c, "right") : np.searchsorted(off, c + size + LENGTH, "right")]
        np.add.at(inside, np.clip(ends - LENGTH + 1 - c, 0, size), 1)
        np.add.at(inside, np.clip(ends - c, 0, size), -1)
        start = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        seed = place[start].astype(np.int64)
        bounds = group_bounds(seed)
        found.append((seed[bounds[:-1]] + c, _spread(hashes[seed[bounds[:-1]]]), start[bounds[:-1]] + c, start[bounds[1:] - 1] + c))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seed, hashes, first, last = (np.concatenate(x) for x in zip(*found))
    bounds = group_bounds(seed)  # a chunk's end may cut the strings of a seed
    return seed[bounds[:-1]], hashes[bounds[:-1]], first[bounds[:-1]], last[bounds[1:] - 1] if len(seed) else last


def _used(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which columns of each row hold bytes."""
    return np.where(_COLUMNS < LENGTH, _COLUMNS < right[:, None], _COLUMNS - LENGTH < left[:, None])


def rows_of(data: np.ndarray, seed: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    padded = np.concatenate((data, np.zeros(LENGTH, np.uint8)))
    right, left = (last + LENGTH - seed).astype(np.uint8), (seed - first).astype(np.uint8)
    out = np.empty((len(seed), _WIDTH), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view
    out[:, :LENGTH] = view(padded, LENGTH)[seed]
    out[:, LENGTH:-2] = view(padded, _LEFT)[first]
    out[:, :-2] *= _used(right, left)
    out[:, -2], out[:, -1] = right, left + 1
    return out


def _shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), _WIDTH)
    return out


def encode(rows: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row behind the shared ones, and where each row's begin."""
    new = _used(rows[:, -2], rows[:, -1] - np.uint8(1)) & (_COLUMNS >= shared[:, None])
    return rows[:, :-2][new], np.concatenate(([0], np.cumsum(new.sum(1, dtype=np.int64))))


def decode(shared: np.ndarray, right: np.ndarray, left: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The rows again; the first of each run shares nothing."""
    rows = np.zeros((len(shared), _WIDTH), np.uint8)
    rows[:, -2], rows[:, -1] = right, left + 1
    new = _used(right, left) & (_COLUMNS >= shared[:, None])
    flat = np.zeros((len(shared), _WIDTH - 2), np.uint8)
    flat[new] = tails
    places = np.arange(len(shared), dtype=np.int32)
    for c in range(int(shared.max(initial=0))):
        if c < _WIDTH - 2:
            flat[:, c] = flat[np.maximum.accumulate(np.where(shared <= c, places, 0)), c]
    rows[:, :-2] = flat
    return rows


def _seed_hash(rows: np.ndarray) -> np.ndarray:
    lanes = np.ascontiguousarray(rows[:, :SEED]).view("<u8")
    return _spread(mix(mix(lanes[:, 0]) * _ODD + lanes[:, 1]))


def strings_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row and the offset (from the row's first start) of each string, and two hashes of it."""
    right, left = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    used = _used(rows[:, -2], rows[:, -1] - np.uint8(1))
    flat = np.concatenate((rows[:, LENGTH:-2], rows[:, :LENGTH]), 1)[np.concatenate((used[:, LENGTH:], used[:, :LENGTH]), 1)]
    count = right + left - LENGTH + 1
    ends = np.cumsum(count)
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(ends - count, count)
    start = np.repeat(np.cumsum(right + left) - right - left, count) + offset
    lanes, one, two = _lanes(flat), np.full(len(row), 1, np.uint64), np.full(len(row), 2, np.uint64)
    for shift in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        part = lanes[start + shift]
        one, two = mix(one * _ODD + part), mix((two ^ part) * np.uint64(0xD1342543DE82EF95) + np.uint64(shift))
    return row, offset, one, two


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket of documents; _bucket_column is the same as an expression."""
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(15)) ^ (x >> np.uint64(31))).view(np.int64)
    return np.mod(x, buckets).astype(np.int32)


def _bucket_column(buckets: int):
    x = F.coalesce("doc_id", F.lit(_NO_ID))
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 15)).bitwiseXOR(F.shiftrightunsigned(x, 31)), F.lit(buckets)).cast("int")


_FOUND = "bucket int, spans binary, one long, two long, doc_id long, text_hash long, start long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_DEALT_NAMES = ["shard", "payload", *_FOUND_NAMES]


def _spans(ids, hashes, start, end, buckets: int) -> pa.RecordBatch:
    """Covered spans of documents, in a row for each bucket."""
    bucket = _bucket(ids, buckets)
    order = np.lexsort((start, hashes, ids, bucket))
    ids, hashes, start, end, bucket = ids[order], hashes[order], start[order], end[order], bucket[order]
    bounds = group_bounds(bucket)
    packed = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        inner = group_bounds(mix(ids[a:z].view(np.uint64)) + hashes[a:z].view(np.uint64))
        own = slice(a, z)
        packed.append(pack(ids[own][inner[:-1]], hashes[own][inner[:-1]], np.diff(inner).astype(np.uint32), start[own].astype(np.uint32), (end[own] - start[own]).astype(np.uint32)))
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]] if n else [], pa.int32()), pa.array(packed, pa.binary()), *[pa.nulls(n, pa.int64())] * 5], _FOUND_NAMES)


def _single(rows, owner, ids, hashes, first) -> pa.RecordBatch:
    """Each string of some suffixes as a row of its own. owner: the suffix of each place; ids, hashes, first: of places."""
    at, offset, one, two = strings_of(rows)
    starts = np.searchsorted(at, np.arange(len(rows) + 1))
    count = np.diff(starts)[owner]
    place = np.repeat(np.arange(len(owner)), count)
    ends = np.cumsum(count)
    string = np.arange(len(place)) - np.repeat(ends - count, count) + np.repeat(starts[owner], count)
    n = len(place)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *[pa.array(x.view(np.int64)) for x in (one[string], two[string], ids[place], hashes[place], first[place] + offset[string])]], _FOUND_NAMES)


def _keys(batch: pa.RecordBatch, shards: int, buckets: int):
    """The block's seeds by shard, and the places (row and number in it) of those that documents with different ids of the block have.

    Of such a seed the shard hears once, so that a seed of very many documents costs it a row for each block.
    """
    id_ = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    hash_ = batch.column("text_hash").to_numpy().astype(np.int64)
    data, off = utf8(batch.column("text"))
    seed, key, _, _ = suffixes(data, off)
    doc = np.searchsorted(off, seed, "right") - 1
    number = np.arange(len(seed)) - np.searchsorted(seed, off[:-1])[doc]
    order = np.argsort(key, kind="stable")
    key, doc, number = key[order], doc[order], number[order]
    bounds = group_bounds(key)
    ids, size = id_[doc], np.diff(bounds)
    several = np.minimum.reduceat(ids, bounds[:-1]) < np.maximum.reduceat(ids, bounds[:-1]) if len(ids) else np.zeros(0, bool)
    each = np.repeat(several, size)
    yield None, _spans(ids[each], hash_[doc[each]], number[each], number[each], buckets)
    told = ~each
    told[bounds[:-1]] = True
    key, doc, number, known = key[told], doc[told], number[told], each[told]
    cut = group_bounds(range_shard(key, shards))
    out = []
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        docs, rank = np.unique(doc[a:z], return_inverse=True)
        step = np.diff(key[a:z], prepend=np.uint64(0))
        out.append((int(range_shard(key[a : a + 1], shards)[0]), _squeezed(pack(known[a:z], step.astype(np.uint32), (step >> np.uint64(32)).astype(np.uint32), rank.astype(np.uint16), number[a:z].astype(np.uint32), id_[docs], hash_[docs]))))
    yield [s for s, _ in out], [p for _, p in out]


def _shared_seeds(payloads: list, buckets: int) -> pa.RecordBatch:
    """The places of seeds that documents with different ids have, but for those that their own block knows already."""
    parts = [unpack(_opened(p), bool, np.uint32, np.uint32, np.uint16, np.uint32, np.int64, np.int64) for p in payloads]
    known, number = (np.concatenate([p[i] for p in parts]) for i in (0, 4))
    key = np.concatenate([np.cumsum(p[1] | (p[2].astype(np.uint64) << np.uint64(32))) for p in parts])
    ids, hashes = (np.concatenate([p[i][p[3]] for p in parts]) for i in (5, 6))
    order = np.argsort(key, kind="stable")
    bounds = group_bounds(key[order])
    some = np.zeros(len(key), bool)
    differ = (np.minimum.reduceat(ids[order], bounds[:-1]) < np.maximum.reduceat(ids[order], bounds[:-1])) | np.logical_or.reduceat(known[order], bounds[:-1])
    some[order] = np.repeat(differ, np.diff(bounds))
    some &= ~known
    number = number[some].astype(np.int64)
    return _spans(ids[some], hashes[some], number, number, buckets)


def _dealt(batch: pa.RecordBatch, shards: int, buckets: int, found=None):
    """A block's sorted run, cut by shard and front-coded, and the spans of its documents that an earlier document of the block has. found: the numbers of the suffixes that count (else all)."""
    id_ = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    hash_ = batch.column("text_hash").to_numpy().astype(np.int64)
    data, off = utf8(batch.column("text"))
    seed, key, first, last = suffixes(data, off)
    if found is not None:
        begin = np.searchsorted(seed, off[:-1])
        numbers = [found.of(k)[0] for k in zip(id_.tolist(), hash_.tolist())]
        some = np.unique(np.repeat(begin, [len(x) for x in numbers]) + np.concatenate(numbers)) if numbers else np.zeros(0, np.int64)
        seed, key, first, last = seed[some], key[some], first[some], last[some]
    doc = np.searchsorted(off, seed, "right") - 1
    rows = rows_of(data, seed, first, last)
    shard = range_shard(key, shards).astype(np.int64)
    order = np.argsort(rows.view(f"S{_WIDTH}").ravel()) if len(rows) else np.zeros(0, np.int64)
    order = order[np.argsort(shard[order], kind="stable")]
    rows, shard, doc = rows[order], shard[order], doc[order]
    start, end = first[order] - off[doc], (last - first + LENGTH)[order]
    shared = _shared(rows)
    new = shared < _WIDTH
    new[:1] = True
    bounds = np.append(np.flatnonzero(new), len(rows))
    least = np.minimum.reduceat(id_[doc], bounds[:-1]) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(bounds)
    later = id_[doc] > np.repeat(least, size)
    yield None, _spans(id_[doc[later]], hash_[doc[later]], start[later], start[later] + end[later], buckets)
    # What the first holder has goes to the shards: each distinct suffix once, with all its places there.
    places = np.bincount(np.repeat(np.arange(len(size)), size)[~later], minlength=len(size)) if len(rows) else size
    doc, start = doc[~later], start[~later]
    rows, shard = rows[bounds[:-1]], shard[bounds[:-1]]
    cut = group_bounds(shard)
    shared = np.minimum(_shared(rows), _WIDTH - 2).astype(np.uint8)
    shared[cut[:-1]] = 0
    tails, tail_at = encode(rows, shared)
    place_at = np.concatenate(([0], np.cumsum(places)))
    out = []
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = slice(place_at[a], place_at[z])
        docs, rank = np.unique(doc[own], return_inverse=True)
        out.append((int(shard[a]), _squeezed(pack(shared[a:z], rows[a:z, -2], rows[a:z, -1] - 1, tails[tail_at[a] : tail_at[z]], places[a:z].astype(np.uint32), rank.astype(np.uint16), start[own].astype(np.uint32), id_[docs], hash_[docs]))))
    yield [s for s, _ in out], [p for _, p in out]


def _squeezed(payload: bytes) -> bytes:
    """Suffixes compressed behind their number and size."""
    return np.array([np.frombuffer(payload, np.uint32, 1)[0], len(payload)], np.uint32).tobytes() + zstandard.compress(payload, 1)


def _opened(payload) -> bytes:
    return zstandard.decompress(memoryview(payload)[8:], int(np.frombuffer(payload, np.uint32, 2)[1]))


class _Runs:
    """Decoded suffixes of a shard: rows, the run of each, its document's id, and its places."""

    def __init__(self, payloads: list, run: int):
        parts = [unpack(_opened(p), np.uint8, np.uint8, np.uint8, np.uint8, np.uint32, np.uint16, np.uint32, np.int64, np.int64) for p in payloads]
        shared, right, left, tails, places, start = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4, 6))
        self.rows, self.shared = decode(shared, right, left, tails), shared
        self.run = np.repeat(np.arange(run, run + len(parts)), [len(p[0]) for p in parts])
        self.places, self.start = places.astype(np.int64), start.astype(np.int64)
        self.place_id, self.place_hash = (np.concatenate([p[i][p[5]] for p in parts]) for i in (7, 8))
        self.key = _seed_hash(self.rows)
        self.id = self.place_id[np.cumsum(self.places) - self.places]

    def take(self, some: np.ndarray) -> tuple:
        """rows, owner of each place, and the places' ids, hashes and starts, of some suffixes."""
        each = np.repeat(some, self.places)
        return self.rows[some], np.repeat(np.arange(int(some.sum())), self.places[some]), self.place_id[each], self.place_hash[each], self.start[each]

    def keep(self, some: np.ndarray) -> None:
        """Only some suffixes; each shares with the one kept before it in the run what all between share."""
        each, kept = np.repeat(some, self.places), np.flatnonzero(some)
        shared = np.minimum.reduceat(self.shared[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1))) if len(kept) else self.shared[:0]
        self.rows, self.shared, self.run, self.key, self.id, self.places = self.rows[some], shared, self.run[some], self.key[some], self.id[some], self.places[some]
        self.place_id, self.place_hash, self.start = self.place_id[each], self.place_hash[each], self.start[each]


def _join(groups: list) -> _Runs:
    out = groups[0]
    for name in ("rows", "shared", "run", "key", "id", "places", "place_id", "place_hash", "start") if len(groups) > 1 else ():
        setattr(out, name, np.concatenate([getattr(g, name) for g in groups]))
    return out


def _settled(runs: _Runs, buckets: int):
    """Spans of the documents whose strings an earlier document has."""
    # Seeds that documents with different ids hold.
    order = np.argsort(runs.key, kind="stable")
    bounds = group_bounds(runs.key[order])
    ids = runs.id[order]
    differ = np.minimum.reduceat(ids, bounds[:-1]) < np.maximum.reduceat(ids, bounds[:-1])
    some = np.zeros(len(order), bool)
    some[order] = np.repeat(differ, np.diff(bounds))
    runs.keep(some)
    if not len(runs.rows):
        return
    strings = runs.rows.view(f"S{_WIDTH}").ravel().tolist()
    cut = group_bounds(runs.run)
    pieces = [(strings[a:z], [0, *runs.shared[a + 1 : z].tolist()]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
    del strings
    which, shared = merge(pieces, _WIDTH)
    del pieces
    which, shared = np.array(which), np.array(shared)
    order = cut[:-1][which] + _rank(which)  # merged order: the next of its run each time
    new = shared < _WIDTH
    new[0] = True
    alike = np.cumsum(new) - 1  # suffixes that are equal
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(runs.id[order], heads)
    ids, hashes, starts, ends = [], [], [], []
    place_end = np.cumsum(runs.places)
    place_at = place_end - runs.places

    def cover(suffix: np.ndarray, offset: np.ndarray, size: np.ndarray) -> None:
        n = runs.places[suffix]
        ends_ = np.cumsum(n)
        place = np.arange(ends_[-1] if len(ends_) else 0) - np.repeat(ends_ - n, n) + np.repeat(place_at[suffix], n)
        ids.append(runs.place_id[place])
        hashes.append(runs.place_hash[place])
        starts.append(runs.start[place] + np.repeat(offset, n))
        ends.append(starts[-1] + np.repeat(size, n))

    whole = order[runs.id[order] > least[alike]]
    reach = runs.rows[:, -2].astype(np.int64) + runs.rows[:, -1] - 1
    cover(whole, np.zeros(len(whole), np.int64), reach[whole])
    # Strings of different suffixes with one seed.
    group = np.cumsum(shared[heads] < SEED)
    count = np.bincount(group)[group] > 1
    # The suffixes of each class that its least document holds, for what is found of the class.
    first = runs.id[order] == least[alike]
    holder, holder_class = order[first], alike[first]
    heads, group, least = heads[count], group[count], least[count]
    rows = runs.rows[order[heads]]
    class_at = np.searchsorted(holder_class, np.arange(alike[-1] + 2))
    classes = alike[heads]
    n = reach[order[heads]] - LENGTH + 1
    total, a = np.cumsum(n), 0
    while a < len(heads):
        z = int(np.searchsorted(total, total[a] - n[a] + _STRINGS, "right"))
        z = max(z, a + 1)
        z = int(np.searchsorted(group, group[min(z, len(group)) - 1], "right"))  # to the end of its seed's group
        row, offset, one, two = strings_of(rows[a:z])
        by = np.lexsort((two, one))
        edge = np.ones(len(by), bool)
        edge[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
        at = np.append(np.flatnonzero(edge), len(by))
        own = least[a:z][row]
        hit = np.zeros(len(by), bool)
        hit[by] = own[by] > np.repeat(np.minimum.reduceat(own[by], at[:-1]), np.diff(at))
        hit = np.flatnonzero(hit)
        if len(hit):
            begin = np.ones(len(hit), bool)
            begin[1:] = (row[hit][1:] != row[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1)
            b = np.append(np.flatnonzero(begin), len(hit))
            lead, tail = hit[b[:-1]], hit[b[1:] - 1]
            c = classes[a:z][row[lead]]
            m = class_at[c + 1] - class_at[c]
            ends_ = np.cumsum(m)
            pick = np.arange(ends_[-1]) - np.repeat(ends_ - m, m) + np.repeat(class_at[c], m)
            cover(holder[pick], np.repeat(offset[lead], m), np.repeat(offset[tail] - offset[lead] + LENGTH, m))
        a = z
    yield _spans(np.concatenate(ids), np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), buckets)


def _rank(which: np.ndarray) -> np.ndarray:
    """How many times each value came before."""
    order = np.argsort(which, kind="stable")
    bounds = group_bounds(which[order])
    out = np.empty(len(which), np.int64)
    out[order] = np.arange(len(which)) - np.repeat(bounds[:-1], np.diff(bounds))
    return out


def _settle(batches, buckets: int):
    held, waiting, size, run, hot, limit, shard = [], [], 0, 0, np.zeros(0, np.uint64), HELD, None

    def decoded():
        """What waits joins what is held; strings of hot seeds leave at once."""
        nonlocal waiting, size, run, hot, limit
        if waiting:
            group = _Runs(waiting, run)
            run, waiting, size = run + len(waiting), [], 0
            yield from shed(group)
            held.append(group)
        if sum(len(g.rows) for g in held) > limit:
            keys, n = np.unique(np.concatenate([g.key for g in held]), return_counts=True)
            hot = np.union1d(hot, keys[n > HOT])
            for g in held:
                yield from shed(g)
            limit = max(HELD, 2 * sum(len(g.rows) for g in held))

    def shed(group):
        out = np.isin(group.key, hot) if len(hot) else np.zeros(len(group.key), bool)
        if out.any():
            rows, owner, ids, hashes, first = group.take(out)
            bounds = np.searchsorted(owner, np.arange(0, len(rows) + 20_000, 20_000))
            for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
                yield _single(rows[20_000 * i : 20_000 * (i + 1)], owner[a:z] - 20_000 * i, ids[a:z], hashes[a:z], first[a:z])
            group.keep(~out)

    def ended():
        nonlocal held, run, hot, limit
        yield from decoded()
        if held and sum(len(g.rows) for g in held):
            yield from _settled(_join(held), buckets)
        held, run, hot, limit = [], 0, np.zeros(0, np.uint64), HELD

    for batch in batches:
        own = pc.is_null(batch.column("payload"))
        yield batch.filter(own).select(_FOUND_NAMES)
        batch = batch.filter(pc.invert(own))
        for s, p in zip(batch.column("shard").to_pylist(), batch.column("payload")):
            if s != shard:
                yield from ended()
                shard = s
            waiting.append(p.as_buffer())
            size += int(np.frombuffer(waiting[-1], np.uint32, 1)[0])
            if size >= GROUP:
                yield from decoded()
    yield from ended()


def _exchanged(blocks_, shards: int):
    """Rows by shard, and rows that are done, of one kind."""
    for shard, x in blocks_:
        if shard is None:
            columns = [pa.array(x.column("bucket").to_numpy() % shards, pa.int32()), pa.nulls(x.num_rows, pa.binary()), *x.columns]
        else:
            n = len(x)
            columns = [pa.array(shard, pa.int32()), pa.array(x, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int64())] * 5]
        yield pa.RecordBatch.from_arrays(columns, _DEALT_NAMES)


def _by_shard(dealt: DataFrame, shards: int, settle) -> DataFrame:
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(settle, _FOUND)


def _shards(docs: DataFrame, each: int) -> int:
    """So many that one has about `each` suffixes; at least as many as Spark's own."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (each * BYTES_EACH)))


def shared_seeds(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, spans: for the documents of a bucket, the numbers of those suffixes whose seed (by its hash) a document with another id has too. docs: doc_id, text, text_hash."""
    shards = _shards(docs, 4 * SHARD_SUFFIXES)

    def deal(batches):
        for b in blocks(batches, size=BLOCK, docs=DOCS):
            yield from _exchanged(_keys(b, shards, buckets), shards)

    def settle(batches):
        held, shard = [], None
        for batch in batches:
            own = pc.is_null(batch.column("payload"))
            yield batch.filter(own).select(_FOUND_NAMES)
            batch = batch.filter(pc.invert(own))
            for s, p in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if s != shard and held:
                    yield _shared_seeds(held, buckets)
                    held = []
                shard = s
                held.append(p.as_buffer())
        if held:
            yield _shared_seeds(held, buckets)

    return materialise(_by_shard(docs.mapInArrow(deal, f"shard int, payload binary, {_FOUND}"), shards, settle).select("bucket", "spans"))


def repeated_spans(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, spans: for the documents of a bucket, the spans of bytes (packed) that strings of LENGTH bytes cover which also start in a document with a smaller id.

    docs: doc_id, text, text_hash. A suffix that several documents of a block have goes to its shard for the first of them only, and with it the ids of just the documents it names. A task that gets
    too many suffixes of one seed gives out their strings one by one; those meet by hash (128 bits) in a join of their own.
    """
    shared, shards = shared_seeds(docs, buckets), _shards(docs, SHARD_SUFFIXES)

    def deal(b, found):
        yield from _exchanged(_dealt(b, shards, buckets, found), shards)

    def settle(batches):
        return _settle(batches, buckets)

    def packed(batches):
        for b in batches:
            ids, hashes, start = (b.column(c).to_numpy() for c in ("doc_id", "text_hash", "start"))
            yield _spans(ids, hashes, start, start + LENGTH, buckets)

    dealt = _beside(docs, shared, buckets, deal, f"shard int, payload binary, {_FOUND}")
    found = materialise(_by_shard(dealt, shards, settle))
    discard(shared)
    single = found.filter("spans IS NULL")
    least = single.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    later = single.join(least, ["one", "two"]).filter("doc_id > least").select("doc_id", "text_hash", "start")
    return found.filter("spans IS NOT NULL").unionByName(later.mapInArrow(packed, _FOUND)).select("bucket", "spans")


class _Found:
    """What was found of a bucket's documents: spans, or numbers of suffixes."""

    def __init__(self, packed: list):
        self.spans: dict = {}
        for p in packed:
            ids, hashes, n, start, size = unpack(p, np.int64, np.int64, np.uint32, np.uint32, np.uint32)
            ends = np.cumsum(n)
            for i, h, a, z in zip(ids.tolist(), hashes.tolist(), (ends - n).tolist(), ends.tolist()):
                self.spans.setdefault((i, h), []).append((start[a:z], size[a:z]))

    def of(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        parts = self.spans.get(key, ())
        start = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        return start, start + np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else start


def _beside(docs: DataFrame, found: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """work(block, what was found of its documents) for all documents, in one shuffle of the texts: what was found of a bucket stands in front of its documents."""
    both = docs.select(_bucket_column(buckets).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("spans"), "doc_id", "text", "text_hash")
    both = found.select("bucket", F.lit(0).alias("kind"), "spans").unionByName(both, allowMissingColumns=True)
    both = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")

    def run(batches):
        packed, ready = [], None
        for batch in batches:
            lead = int((batch.column("kind").to_numpy() == 0).sum())
            packed += [x.as_buffer() for x in batch.column("spans").slice(0, lead)]
            if lead < batch.num_rows:
                ready = ready or _Found(packed)
                for b in blocks([batch.slice(lead)]):
                    yield from work(b, ready)

    return both.mapInArrow(run, schema)


def _kept(b: pa.RecordBatch, found: _Found) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans and the bytes left of each text."""
    data, off = utf8(b.column("text"))
    ids = pc.fill_null(b.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    cover = np.zeros(len(data) + 1, np.int32)
    for i, key in enumerate(zip(ids.tolist(), b.column("text_hash").to_pylist())):
        start, end = found.of(key)
        if len(start):
            np.add.at(cover, start + off[i], 1)
            np.add.at(cover, end + off[i], -1)
    gone = np.cumsum(cover[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
    sums = [np.concatenate(([0], np.cumsum(x)))[off] for x in (gone, begins)]
    left = off - sums[0]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
    return [pa.array(np.diff(off)), *[pa.array(np.diff(x)) for x in sums], kept.cast(pa.binary())]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, which need not be whole characters) for every row.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id; strings are those
    of the input and lie within one document. Null text has no bytes. Rows with one id don't take from one another; a null id is the greatest. Other columns don't matter.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # one for each partition of the texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def cover(b, found):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_kept(b, found)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _beside(rows, repeated_spans(rows, buckets), buckets, cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null and empty texts: no bytes, the hash of nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Substring deduplication by recompression.

Three rounds name runs of equal symbols and pairs of neighbours (one of the left half, one of the right half of
the alphabet, by a bit of the name). A name is a hash of its content, so that it is the same in every document and
every task without a dictionary, and a boundary between symbols depends on CONTEXT words to each side at most:
equal passages have equal interior symbols. Each window of WINDOW words hangs on the first high-level boundary well
inside it; the symbols around that boundary (REACH words to each side) are the key by which windows of different
documents meet. A key that several documents share reveals a possible repeat; the windows that hang on it, compared by
hash, verify it. A window without such a boundary (inside a long run, say) hangs on a place fixed by its start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.llm.common import (
    Spans, block_bytes, blocks, discard, find_words, group_bounds, is_member, materialise, mix, pack, range_shard, run_hashes, unpack, utf8, word_hashes,
)

WINDOW = 13
CONTEXT = 4
REACH = 4
BLOCK, DOCS = 3 << 20, 60_000
#: A key with this many windows in one block is counted over all blocks; those with over 1 / HOT of all windows (at most HOT) are dealt out by window.
OFTEN, HOT = 8, 50_000
#: Windows of a shard, and shards at most: what one task settles.
SHARD_WINDOWS, SHARDS = 1_000_000, 100_000
#: Buckets of documents for each shuffle partition.
BUCKETS = 8
_NO_ID = int(np.iinfo(np.int64).max)
#: Seeds of a word's two hashes: one for names and keys, one for windows.
_SEEDS = (1, 2)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right)


def _color(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(23)) & np.uint64(1) == 1


def boundaries(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a symbol of the third round begins at each word.

    A run is one symbol, whose colour doesn't depend on its length (so a window need not see all of it).
    """
    n = len(words)
    if not n:
        return np.zeros(0, bool)
    inside = np.concatenate(([False], doc[1:] == doc[:-1]))
    run = np.concatenate(([False], words[1:] == words[:-1])) & inside

    def at(values: np.ndarray, shift: int) -> np.ndarray:
        """values[i + shift], the ends repeated."""
        return values[np.clip(np.arange(n) + shift, 0, n - 1)]

    color = _color(words)
    pair1 = inside & ~run & ~at(color, -1) & color  # the words i - 1 and i are one symbol
    bound1 = ~run & ~pair1
    # Names of the symbol that ends at i, and of the one that begins at i.
    ends = np.where(pair1, _joined(at(words, -1), words), words)
    begins = np.where(at(pair1, 1), _joined(words, at(words, 1)), words)
    begins[-1] = words[-1]
    pair2 = inside & bound1 & ~_color(at(ends, -1)) & _color(begins)
    bound2 = bound1 & ~pair2
    place = np.arange(n)
    start = place - pair1  # of the first-round symbol that ends at i
    ends3 = np.where(pair2[start], _joined(ends[np.maximum(start - 1, 0)], ends), ends)
    after = place + np.concatenate((pair1[1:], [False])) + 1  # behind the symbol that begins at i
    behind = np.minimum(after, n - 1)
    begins3 = np.where((after < n) & pair2[behind], _joined(begins, begins[behind]), begins)
    pair3 = inside & bound2 & ~_color(at(ends3, -1)) & _color(begins3)
    return bound2 & ~pair3


def windows(words: np.ndarray, doc: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, key and hash of each window; key and hash are of different hashes of the words, if `other` is given, and 128 bits together."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    other = words if other is None else other
    first = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    place = np.where(boundaries(words, doc), np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    anchor = following[first + CONTEXT]
    anchor = np.where(anchor <= first + WINDOW - REACH, anchor, first + CONTEXT)
    return first, run_hashes(words, 2 * REACH)[anchor - REACH], run_hashes(other, WINDOW)[first]


def window_id(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """64 bits of a window, by which a document's windows are told apart."""
    return mix(key + whole * np.uint64(0xD1342543DE82EF95))


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (words, other), doc = word_hashes(data, off, seeds=_SEEDS)
    return words, other, doc


def _block_windows(batch: pa.RecordBatch):
    """The block's ids in order; then key, hash and rank of its windows, ordered by rank."""
    ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    known, rank = np.unique(ids[order], return_inverse=True)
    words, other, doc = _words(*utf8(batch.column("text").take(pa.array(order))))
    first, key, whole = windows(words, doc, other)
    return known, key, whole, rank[doc[first]] if len(first) else np.zeros(0, np.int64)


def _least_holders(key: np.ndarray, whole: np.ndarray, rank: np.ndarray):
    """Ids of all windows; those whose window starts in an earlier document of the block too; for each distinct window its first holder."""
    ids = window_id(key, whole)
    order = np.argsort(ids, kind="stable")
    sorted_ids, sorted_key = ids[order], key[order]
    new = np.ones(len(ids), bool)
    new[1:] = (sorted_ids[1:] != sorted_ids[:-1]) | (sorted_key[1:] != sorted_key[:-1])
    bounds = np.append(np.flatnonzero(new), len(ids))
    first = order[bounds[:-1]]
    later = np.repeat(rank[first], np.diff(bounds)) < rank[order]
    return ids, order[later], first


def _by_key(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rank, key))
    return order, group_bounds(mix(key[order]) + rank[order].astype(np.uint64))


def _frequent(batches):
    """Keys with many windows in a block (and null for the sum of all)."""
    total = 0
    for b in blocks(batches, size=BLOCK, docs=DOCS):
        _, key, whole, rank = _block_windows(b)
        _, _, first = _least_holders(key, whole, rank)
        keys, n = np.unique(key[first], return_counts=True)
        total += len(first)
        some = n >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["key", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["key", "n"])


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket of documents; _bucket_column is the same as an expression."""
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(15)) ^ (x >> np.uint64(31))).view(np.int64)
    return np.mod(x, buckets).astype(np.int32)


def _bucket_column(buckets: int) -> Column:
    x = F.coalesce("doc_id", F.lit(_NO_ID))
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 15)).bitwiseXOR(F.shiftrightunsigned(x, 31)), F.lit(buckets)).cast("int")


def _by_bucket(doc: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Window ids of documents, packed into a row for each bucket: documents, windows of each, windows."""
    bucket = _bucket(doc, buckets)
    order = np.lexsort((doc, bucket))
    doc, ids, bucket = doc[order], ids[order], bucket[order]
    bounds = group_bounds(bucket)
    packed = []
    for a, z in zip(bounds[:-1], bounds[1:]):
        inner = group_bounds(doc[a:z])
        packed.append(pack(doc[a:z][inner[:-1]], np.diff(inner).astype(np.uint32), ids[a:z]))
    return pa.array(bucket[bounds[:-1]] if len(doc) else [], pa.int32()), pa.array(packed, pa.binary())


def repeated_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, windows: for the documents of a bucket, the ids (64 bits each, packed) of those windows whose words also start in a document with a smaller id.

    Windows of different documents are equal if all 128 bits of key and hash are. Within a block of documents a window
    is kept for its first document only; so a passage that many documents share costs a row for each block. A null id
    stands as the greatest. Shards follow the counted windows, and blocks grow with the shards, so that a row is never
    just a few windows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    counted = rows.mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    total = counted.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("key").isNotNull() & (F.col("n") > total / HOT)).collect()  # fewer than HOT
    discard(counted)
    shared = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64)))
    shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WINDOWS)))
    size = max(BLOCK, block_bytes(shards))

    def deal(batches):
        often = shared.value
        for b in blocks(batches, size=size, docs=DOCS):
            known, key, whole, rank = _block_windows(b)
            ids, later, first = _least_holders(key, whole, rank)
            rows_ = []
            at = is_member(key[first], often)
            cold, warm, warm_key = first[at < 0], first[at >= 0], at[at >= 0]
            order, bounds = _by_key(key[cold], rank[cold])
            cold = cold[order]
            cut = np.searchsorted(range_shard(key[cold][bounds[:-1]], shards), np.arange(shards + 1)) if len(cold) else np.zeros(shards + 1, np.int64)
            order = np.argsort(ids[warm])
            warm, warm_key = warm[order], warm_key[order]
            warm_cut = np.searchsorted(range_shard(ids[warm], shards), np.arange(shards + 1))
            for s in np.flatnonzero((np.diff(cut) > 0) | (np.diff(warm_cut) > 0)).tolist():
                g, h = bounds[cut[s] : cut[s + 1] + 1], slice(warm_cut[s], warm_cut[s + 1])
                lead, inside = cold[g[:-1]], cold[g[0] : g[-1]] if len(g) > 1 else cold[:0]
                rows_.append((s, _payload(known, key[lead], rank[lead], np.diff(g), whole[inside], warm_key[h], whole[warm[h]], rank[warm[h]])))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows_], pa.int32()), pa.array([p for _, p in rows_], pa.binary()), pa.nulls(len(rows_), pa.int32()), pa.nulls(len(rows_), pa.binary())], _DEALT)
            bucket, packed = _by_bucket(known[rank[later]], ids[later], buckets)
            yield pa.RecordBatch.from_arrays([pc.cast(pa.array(bucket.to_numpy() % shards), pa.int32()), pa.nulls(len(bucket), pa.binary()), bucket, packed], _DEALT)

    def settle(batches):
        held, shard = [], None
        for batch in batches:
            own = pc.is_null(batch.column("payload"))
            yield batch.filter(own).select(_DEALT[2:])
            batch = batch.filter(pc.invert(own))
            for s, p in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                if s != shard and held:
                    yield _settled(held, shared.value, buckets)
                    held = []
                shard = s
                held.append(p.as_buffer())
        if held:
            yield _settled(held, shared.value, buckets)

    dealt = rows.mapInArrow(deal, "shard int, payload binary, bucket int, windows binary")
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(settle, "bucket int, windows binary")


def _payload(known, key, rank, sizes, whole, warm_key, warm_whole, warm_rank) -> bytes:
    """What a block gives to a shard; of its documents just those that have something there."""
    docs, at = np.unique(np.concatenate((rank, warm_rank)), return_inverse=True)
    at = at.astype(np.uint16)
    return pack(np.diff(known[docs], prepend=0), *_steps(key), at[: len(rank)], sizes.astype(np.uint32), whole, warm_key.astype(np.uint16), warm_whole, at[len(rank) :])


def _steps(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps between ascending keys, as low and high halves: small ones shrink when they are compressed."""
    step = np.diff(ascending, prepend=np.uint64(0))
    return step.astype(np.uint32), (step >> np.uint64(32)).astype(np.uint32)


_DEALT = ["shard", "payload", "bucket", "windows"]


def _settled(payloads: list, often: np.ndarray, buckets: int) -> pa.RecordBatch:
    keys, holders, sizes, wholes, warm_keys, warm_wholes, warm_docs = [], [], [], [], [], [], []
    for p in payloads:
        known, low, high, rank, n, whole, warm_key, warm_whole, warm_rank = unpack(p, np.int64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint64, np.uint16, np.uint64, np.uint16)
        known, key = np.cumsum(known), np.cumsum(low | (high.astype(np.uint64) << np.uint64(32)))
        keys.append(key)
        holders.append(known[rank])
        sizes.append(n)
        wholes.append(whole)
        warm_keys.append(often[warm_key])
        warm_wholes.append(warm_whole)
        warm_docs.append(known[warm_rank])
    key, holder, size = np.concatenate(keys), np.concatenate(holders), np.concatenate(sizes).astype(np.int64)
    # Revealed: keys with several holders. Verified: their windows.
    order = np.argsort(key, kind="stable")
    bounds = group_bounds(key[order])
    several = np.zeros(len(key), bool)
    several[order] = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    each = np.repeat(several, size)
    key = np.concatenate((np.repeat(key[several], size[several]), *warm_keys))
    whole = np.concatenate((np.concatenate(wholes)[each], *warm_wholes))
    doc = np.concatenate((np.repeat(holder[several], size[several]), *warm_docs))
    order = np.lexsort((doc, whole, key))
    key, whole, doc = key[order], whole[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    bounds = np.append(np.flatnonzero(new), len(key))
    later = doc > np.repeat(doc[bounds[:-1]], np.diff(bounds))
    return pa.RecordBatch.from_arrays(list(_by_bucket(doc[later], window_id(key[later], whole[later]), buckets)), _DEALT[2:])


class _Found:
    """The repeated windows of a bucket's documents."""

    def __init__(self, packed: list):
        parts = [unpack(p, np.int64, np.uint32, np.uint64) for p in packed]
        doc = np.concatenate([np.repeat(d, n) for d, n, _ in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([w for _, _, w in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(doc, kind="stable")
        self.ids, bounds = ids[order], group_bounds(doc[order])
        self.docs, self.bounds = doc[order][bounds[:-1]], bounds

    def of(self, doc: int) -> np.ndarray:
        i = int(np.searchsorted(self.docs, doc))
        return self.ids[self.bounds[i] : self.bounds[i + 1]] if i < len(self.docs) and self.docs[i] == doc else self.ids[:0]


def _kept(b: pa.RecordBatch, found: _Found) -> list[pa.Array]:
    """n_words, n_removed and the words left of each text."""
    doc_ids = pc.fill_null(b.column("doc_id"), _NO_ID).to_numpy().astype(np.int64)
    n = len(doc_ids)
    data, off = utf8(b.column("text"))
    start, end, doc = find_words(data, off)
    keep = np.ones(len(start), bool)
    hit = np.isin(doc_ids, found.docs)
    some = np.flatnonzero(hit[doc])
    if len(some):
        words, other = Spans(data).hash(start[some], end[some], *_SEEDS)
        first, key, whole = windows(words, doc[some], other)
        ids, owner = window_id(key, whole), doc[some][first]
        cover = np.zeros(len(some) + 1, np.int64)
        bounds = group_bounds(owner)
        for a, z in zip(bounds[:-1], bounds[1:]):
            at = first[a:z][np.isin(ids[a:z], found.of(int(doc_ids[owner[a]])))]
            cover[at] += 1
            cover[at + WINDOW] -= 1
        keep[some] = np.cumsum(cover[:-1]) == 0
    n_words, n_kept = np.bincount(doc, minlength=n), np.bincount(doc[keep], minlength=n)
    # The words left, one space behind each but a document's last.
    start, end, doc = start[keep], end[keep], doc[keep]
    width = end - start + np.append(doc[1:] == doc[:-1], np.zeros(min(1, len(doc)), bool))
    ends = np.concatenate(([0], np.cumsum(width)))
    out = np.append(data, np.uint8(32))[np.minimum(np.repeat(start - ends[:-1], width) + np.arange(ends[-1]), len(data))]
    out[(ends[1:] - 1)[width > end - start]] = 32
    offsets = ends[np.searchsorted(doc, np.arange(n + 1))].astype(np.int64)
    kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
    return [pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), kept]


def remove_repeats(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and the named extra columns (text may be one), for every row.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are those of the
    input. Null text has no words. Rows with one id are one document here; each keeps its row. A null id is the greatest.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions
    found = repeated_windows(docs, buckets)
    found = materialise(found)
    others = [c for c in extra if c != "text"]
    inner = {c: f"__extra{i}" for i, c in enumerate(others)}  # names of the caller never meet those used here
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    others = list(inner.values())
    # One shuffle of the texts: what was found of a bucket stands in front of its documents.
    both = rows.select(_bucket_column(buckets).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("windows"), "doc_id", "text", *others)
    both = found.select("bucket", F.lit(0).alias("kind"), "windows").unionByName(both, allowMissingColumns=True)
    both = both.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket", "kind")

    def cover(batches):
        bucket, packed, ready = None, [], None
        for batch in batches:
            which = batch.column("bucket").to_numpy()
            bounds = group_bounds(which * 2 + batch.column("kind").to_numpy())
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = batch.slice(a, z - a)
                if which[a] != bucket:
                    bucket, packed, ready = which[a], [], None
                if part.column("kind")[0].as_py() == 0:
                    packed += [x.as_buffer() for x in part.column("windows")]
                    continue
                ready = ready or _Found(packed)
                for b in blocks([part]):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_kept(b, ready), *(b.column(inner.get(c, c)) for c in extra)], ["doc_id", "n_words", "n_removed", "kept", *names])

    # A clashing name stands for the caller's column only if it isn't one of the results'.
    names = [inner.get(c, c) for c in extra]
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept string", *(f"`{x}` {types[c]}" for c, x in zip(extra, names))])
    return both.mapInArrow(cover, schema).withColumnsRenamed({x: c for c, x in inner.items()})


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, n_words, n_removed, kept_sha256. Null and empty texts: 0 words, the hash of the empty text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

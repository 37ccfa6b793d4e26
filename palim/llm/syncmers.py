"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if its least s-mer (by a mixed hash) is its first or its last: the k-mer alone
decides, so an edit changes only the anchors it touches, and equal passages have equal anchors at equal
relative positions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palim.llm.common import BLOCK_BYTES, blocks, mix, utf8

K, S = 24, 8
#: Least anchor hashes that a fingerprint keeps, 32 bits of each. Likeness has a standard error of at most 0.5 / sqrt(SKETCH).
SKETCH = 128
#: Ranges of doc_id per shuffle partition; neighbours are in one range but for its last document.
RANGES = 4
#: Bytes of text that one task takes at most, ids being distinct.
TASK_BYTES = 64 << 20


def anchors(data: np.ndarray, off: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and document of each closed syncmer (k and s in bytes of UTF-8).

    A text shorter than k bytes, but not empty, has one anchor: all of it. s is 8, so that an s-mer is one 64-bit word.
    """
    n, w = len(data), k - s + 1
    doc_len = np.diff(off)
    starts = hashes = docs = np.zeros(0, np.int64)
    if n >= k:
        word = np.zeros(n - s + 1, np.uint64)
        for j in range(s):
            word |= data[j : n - s + 1 + j].astype(np.uint64) << np.uint64(8 * j)
        mixed = mix(word * np.uint64(0x9E3779B97F4A7C15))
        least, span = mixed, 1  # the least of each window of w, by doubling
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(mixed) - w + 1], least[w - span :][: len(mixed) - w + 1])
        ok = (least == mixed[: n - k + 1]) | (least == mixed[w - 1 :])
        starts = np.flatnonzero(ok)
        docs = np.searchsorted(off, starts, "right") - 1
        inside = starts + k <= off[docs + 1]
        starts, docs = starts[inside], docs[inside]
        h = mixed[starts]
        for j in range(s, k, s):
            h = mix(h ^ (mixed[starts + min(j, k - s)] * np.uint64(2 * j + 1)))
        hashes = h
    short = np.flatnonzero((doc_len > 0) & (doc_len < k))
    if len(short):
        h = _whole(data, off, short)
        starts, docs = np.concatenate((starts, off[short])), np.concatenate((docs, short))
        hashes = np.concatenate((hashes.astype(np.uint64), h))
        order = np.argsort(docs, kind="stable")
        starts, docs, hashes = starts[order], docs[order], hashes[order]
    return starts, hashes.astype(np.uint64), docs


def _least_distinct(docs: np.ndarray, values: np.ndarray, n: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` least distinct values of each document, as values and n + 1 bounds."""
    key = np.unique((docs.astype(np.uint64) << np.uint64(32)) | values)
    d = (key >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(d, np.arange(n + 1))
    key = key[np.arange(len(key)) - bounds[d] < keep]
    d = (key >> np.uint64(32)).astype(np.int64)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(d, np.arange(n + 1))


def _whole(data: np.ndarray, off: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The anchor hash of each whole text."""
    return np.array([int.from_bytes(hashlib.blake2b(data[off[i] : off[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in which], np.uint64)


def all_anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors, and the whole text as one for each text that isn't empty and has no syncmer."""
    starts, hashes, docs = anchors(data, off)
    bare = np.flatnonzero((np.diff(off) > 0) & (np.bincount(docs, minlength=len(off) - 1) == 0))
    if not len(bare):
        return starts, hashes, docs
    starts, hashes, docs = np.concatenate((starts, off[bare])), np.concatenate((hashes, _whole(data, off, bare))), np.concatenate((docs, bare))
    order = np.argsort(docs, kind="stable")
    return starts[order], hashes[order], docs[order]


def sketch_of(found: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of n documents from their anchors (start, hash, document): values and n + 1 bounds. A text without anchors, the empty one, has an empty sketch."""
    _, hashes, docs = found
    return _least_distinct(docs, hashes >> np.uint64(32), n, SKETCH)


def sketches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sketch_of(all_anchors(data, off), len(off) - 1)


def same_until(a: tuple, a_off: np.ndarray, b: tuple, b_off: np.ndarray) -> np.ndarray:
    """For documents of the same number in both: up to which byte their anchors agree in place and hash, one by one from the start. Anchors are context-free, so
    that text before an edit keeps all of its anchors; what is returned is the end of the last of them (0: not even the first agrees)."""
    n = min(len(a_off), len(b_off)) - 1
    out = np.zeros(n, np.int64)
    (a_at, a_hash, a_doc), (b_at, b_hash, b_doc) = a, b
    a_bounds, b_bounds = np.searchsorted(a_doc, np.arange(n + 1)), np.searchsorted(b_doc, np.arange(n + 1))
    for i in range(n):
        m = min(a_bounds[i + 1] - a_bounds[i], b_bounds[i + 1] - b_bounds[i])
        x, y = slice(a_bounds[i], a_bounds[i] + m), slice(b_bounds[i], b_bounds[i] + m)
        differ = np.flatnonzero((a_hash[x] != b_hash[y]) | (a_at[x] - a_off[i] != b_at[y] - b_off[i]))
        k = differ[0] if len(differ) else m
        if k:
            out[i] = min(a_at[x][k - 1] - a_off[i] + K, a_off[i + 1] - a_off[i])
    return out


def likeness(a: tuple, b: tuple, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated share of common anchors of sketch a[left[i]] and b[right[i]]: among the least SKETCH of both together, those in both. Both empty: 1."""
    n = len(left)

    def rows(sketch: tuple, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, bounds = sketch
        size = bounds[which + 1] - bounds[which]
        at = np.repeat(bounds[which] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.repeat(np.arange(n), size), values[at]

    (i, x), (j, y) = rows(a, left), rows(b, right)
    key = np.sort(np.concatenate(((i.astype(np.uint64) << np.uint64(32)) | x, (j.astype(np.uint64) << np.uint64(32)) | y)))
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    both = np.concatenate((key[1:] == key[:-1], [False])) if len(key) else first
    key, both = key[first], both[first]
    d = (key >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(d, np.arange(n + 1))
    low = np.arange(len(key)) - bounds[d] < SKETCH
    total = np.bincount(d[low], minlength=n)
    shared = np.bincount(d[low & both], minlength=n)
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def as_text(sketch: tuple) -> list[str]:
    """Eight hex digits for each kept hash, ascending."""
    values, bounds = sketch
    text = values.astype(">u4").tobytes().hex()
    return [text[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text. Null text counts as empty; the empty text's fingerprint is empty. Rows stay as they are, repeated or with a null id."""

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(as_text(sketches(*utf8(b.column("text")))))], ["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, position (byte of UTF-8) and hash of every anchor, for positional matching."""

    def run(batches):
        for b in blocks(batches):
            data, off = utf8(b.column("text"))
            at, h, d = all_anchors(data, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array(at - off[d]), pa.array(h.view(np.int64))], ["doc_id", "position", "hash"])

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, position long, hash long")


_EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("same_until", T.LongType()),
    ]
)


def _neighbours(rows: list) -> pa.RecordBatch:
    """rows: (is it an own row, doc_id, text), each followed by its next document; the last only follows."""
    texts = [r[2] for r in rows]
    edited = []
    for a, b in zip(texts[:-1], texts[1:]):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    (data, off), (new_data, new_off) = (utf8(pa.array(t, pa.large_string())) for t in (texts, edited))
    placed, new_placed = all_anchors(data, off), all_anchors(new_data, new_off)
    own, new = sketch_of(placed, len(texts)), sketch_of(new_placed, len(edited))
    i = np.arange(len(edited))
    hexes = as_text(own)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[1] for r in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(hexes[:-1], pa.string()),
            pa.array(as_text(new), pa.string()),
            pa.array(likeness(own, new, i, i)),
            pa.array(likeness(own, own, i, i + 1)),
            pa.array(same_until(placed, off, new_placed, new_off)),
        ],
        _EDITED.names,
    )


def _pairs(batches):
    held: list = []
    size = 0
    for batch in batches:
        for range_, follows, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held and held[-1][3] != range_:
                if len(held) > 1:
                    yield _neighbours(held)
                held, size = [], 0
            if held and held[-1][0]:
                continue  # more rows of the id that follows the range
            held.append((follows, doc_id, text or "", range_))
            size += len(text or "")
            if size > BLOCK_BYTES // 2 and len(held) > 1:
                yield _neighbours(held)
                held = held[-1:]
                size = len(held[0][2])
    if len(held) > 1:
        yield _neighbours(held)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, and the byte up to which their anchors agree in place (same_until), in one shuffle of the texts.

    Ranges of ascending doc_id are dealt out whole; the first document of a range also goes to the range
    before it, where it follows the last one. Null ids come before all others, rows with one id in the
    order of their texts. Null text counts as empty. An empty table gives no rows; a lone document is its own next.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    steps = RANGES * partitions
    found = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(1, steps)], 10 * steps).alias("q"), F.count(F.lit(1)).alias("n")).first()
    cuts = np.unique(np.array([x for x in found["q"] or []], np.int64))

    # Ids go with their nulls filled and told apart: a null among them would make them floats.
    filled = F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull()

    def range_of(ids: pd.Series, known: pd.Series) -> np.ndarray:
        return np.where(known.to_numpy(), np.searchsorted(cuts, ids.to_numpy(), "right"), 0)

    number = F.pandas_udf(lambda ids, known: pd.Series(range_of(ids, known)), "long")
    firsts = {r[0]: r[1] for r in docs.select("doc_id").withColumn("r", number(*filled)).groupBy("r").agg(F.when(F.count(F.lit(1)) == F.count("doc_id"), F.min("doc_id")).alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # the first range's first document follows the last range

    @F.pandas_udf("array<long>")
    def ranges(ids: pd.Series, known: pd.Series) -> pd.Series:
        own = range_of(ids, known)
        keys = [x if k else None for x, k in zip(ids.tolist(), known.tolist())]
        return pd.Series([[int(r), before[x]] if x in before else [int(r)] for r, x in zip(own, keys)])

    dealt = docs.select("doc_id", "text", F.posexplode(ranges(*filled)).alias("follows", "range"))
    dealt = dealt.repartition(partitions, "range").sortWithinPartitions("range", "follows", "doc_id", "text")
    return dealt.select("range", "follows", "doc_id", "text").mapInArrow(_pairs, _EDITED)


def op1_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_until. Null text counts as empty, whose fingerprint is empty."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.llm.common import Spans, blocks, find_words, held_out, labelled_sample, mix, utf8

BITS = 14
BUCKETS, VECTOR = 1 << BITS, 16
#: Bound of the training sample: labelled documents of a class, and of all.
PER_CLASS, SAMPLE = 2500, 5000
EPOCHS, BATCH = 12, 64
LEAST_STEPS = 600  # a small sample is passed more often
THRESHOLD = 0.3
_REPEATED = 0  # the bucket of a word bigram of two equal words, which no other n-gram uses


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and documents of all words, word bigrams, and byte 3- and 5-grams (case kept)."""
    start, end, doc = find_words(data, off)
    found, owner = [], []

    def put(h: np.ndarray, d: np.ndarray, kind: int) -> None:
        found.append((mix(h ^ np.uint64(kind * 0x51ED270B)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1)
        owner.append(d.astype(np.int32))

    if len(start):
        h = Spans(data).hash(start, end)
        put(h, doc, 1)
        same = doc[1:] == doc[:-1]
        put((h[:-1] * np.uint64(3) + h[1:])[same], doc[1:][same], 2)
        twice = same & (h[1:] == h[:-1])
        found[-1][twice[same]] = _REPEATED
    position = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = data.astype(np.uint64)
    for order in (3, 5):
        m = len(data) - order + 1
        if m > 0:
            key = np.zeros(m, np.uint64)
            for j in range(order):
                key |= wide[j : j + m] << np.uint64(8 * j)
            inside = position[:m] == position[order - 1 :]
            put(key[inside], position[:m][inside], 3)
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits; those of very long texts are scaled, none to 0."""
    scale = max(1, -(-int(counts.max(initial=1)) // 65535))
    return np.maximum(counts // scale, 1).astype(np.uint16)


def _sample_rows(batches):
    """Label, and the counted buckets of each document."""
    for b in blocks(batches, docs=256):
        data, off = utf8(b.column("text"))
        bucket, doc = ngrams(data, off)
        key, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        bounds = np.searchsorted(key, np.arange(b.num_rows + 1) * BUCKETS)
        key = (key % BUCKETS).astype(np.uint16)
        rows = [(key[a:z].tobytes(), _narrow(n[a:z]).tobytes()) for a, z in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "keys", "counts"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> np.ndarray:
    """Stochastic gradient descent on vectors and softmax weights; gives for each bucket its part of the log odds, and at last the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, VECTOR)).astype(np.float32) / VECTOR
    out = np.zeros((VECTOR, 2), np.float32)
    bias = np.zeros(2, np.float32)
    label = np.array([r[0] for r in rows])
    weight = np.where(label == 1, 0.5 / max(1e-3, (label == 1).mean()), 0.5 / max(1e-3, (label == 0).mean()))
    weight = np.sqrt(weight).astype(np.float32)
    batches = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, t = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), BATCH):
            some = order[i : i + BATCH]
            rate = np.float32(0.5 * (1 - t / steps) * VECTOR)
            t += 1
            size = np.array([len(rows[s][1]) for s in some])
            keys = np.concatenate([rows[s][1] for s in some]).astype(np.int64)
            share = np.concatenate([rows[s][2] / max(1, rows[s][2].sum()) for s in some]).astype(np.float32)
            who = np.repeat(np.arange(len(some)), size)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            hidden = np.add.reduceat(np.concatenate((vectors[keys] * share[:, None], np.zeros((1, VECTOR), np.float32))), first, axis=0)
            hidden[size == 0] = 0
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(2, dtype=np.float32)[label[some]]) * weight[some][:, None] / np.float32(len(some))
            back = g @ out.T
            out -= rate * hidden.T @ g
            bias -= np.float32(0.1 / VECTOR) * rate * g.sum(0)
            change = (rate * np.float32(len(some) ** 0.5) * back)[who] * share[:, None]
            for a, n in zip(first, size):  # a document's buckets are distinct
                vectors[keys[a : a + n]] -= change[a : a + n]
    odds = vectors @ (out[:, 1] - out[:, 0])
    return np.concatenate((odds, [bias[1] - bias[0]])).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Learns from a bounded sample of the labelled rows that aren't held out; None if there is none."""
    _, chosen = labelled_sample(docs, labels, "quality", 5, 0, PER_CLASS, SAMPLE, 3)
    got = chosen.select("label", "text").mapInArrow(_sample_rows, "label int, keys binary, counts binary").collect()
    got.sort()
    rows_ = [(r[0], np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.uint16)) for r in got]
    return fit(rows_) if rows_ else None


def score(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each whole text. Null and empty texts get the score of the bias alone; without a model all get 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 floats

    def run(batches):
        odds = shared.value
        for b in blocks(batches):
            n = b.num_rows
            if odds is None:
                z = np.zeros(n)
            else:
                bucket, doc = ngrams(*utf8(b.column("text")))
                z = np.bincount(doc, odds[bucket], minlength=n) / np.maximum(1, np.bincount(doc, minlength=n)) + odds[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_subwords(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, learned from labelled ones not held out: doc_id, held_out, score, predicted. Null and empty texts get the score of the bias."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

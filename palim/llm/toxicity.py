"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.llm.common import LOWER, Spans, blocks, discard, find_words, held_out, labelled_sample, materialise, per_doc, utf8

#: Bound of the training sample: labelled documents of a class, and of all.
PER_CLASS, SAMPLE = 6000, 12000
#: Bound of the learned lexicon, and what a word or stem needs to enter it: evidence (in nats, against the share of
#: toxic documents in the sample), and toxic share of the documents with it, classes weighing the same.
LEXICON, LEAST_EVIDENCE, LEAST_SHARE = 4000, 14.0, 0.75
STEMS = (5, 6, 7, 8)  # bytes of a word's start that the lexicon may hold besides whole words
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 80, 3, 32, 0.15, 8
THRESHOLD = 0.3
LEAST_SPLIT = 200  # rows of a sample that is split for calibration
NEAR = 5  # words between an insult and a second-person word

#: General seeds; training adds the words that toxic documents use.
SEEDS = "idiot idiots stupid moron loser losers pathetic worthless disgusting scum trash garbage dumb fool ugly hate kill shut fuck fucking shit bitch bastard asshole crap imbécile crétin connard salaud merde dumm idioten arschloch scheiße trottel estúpido idiota imbécil mierda"
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros"

_BYTES = np.arange(256)
_LETTERS = (_BYTES >= 128) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGITS = (_BYTES >= 48) & (_BYTES <= 57)
_WORD_END = ~(_LETTERS | (_BYTES == 39))
#: Characters that stand for letters, and those put between letters.
_LEET = {ord(a): ord(b) for a, b in zip("013457@$!|", "oieastasil")}
_FILLER = "*.-_+~"


_PLAIN = LOWER.copy()
for _a, _b in _LEET.items():
    _PLAIN[_a] = _b


def word_hashes(words: str) -> np.ndarray:
    data, off = utf8(pa.array([words]))
    start, end, _ = find_words(data, off)
    return np.unique(Spans(LOWER[data]).hash(start, end))


def stem_hashes(spans: Spans, start: np.ndarray, end: np.ndarray):
    """For each length: which words are longer, and the hash of their start."""
    for k in STEMS:
        longer = np.flatnonzero(end - start > k)
        yield longer, spans.hash(start[longer], start[longer] + k, 1)[0]


def member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones; a small table by low bits settles most."""
    table = np.zeros(1 << 16, bool)
    table[(sorted_ & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = table[(values & np.uint64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    if len(some):
        at = np.minimum(np.searchsorted(sorted_, values[some]), len(sorted_) - 1)
        out[some] = sorted_[at] == values[some]
    return out


FEATURES = ("stem_hits", "stem_density", "hits", "distinct", "density", "near_person", "person", "caps", "caps_words", "exclaim", "question", "punctuation", "doubled", "digits", "disguised", "disguised_hits", "log_words", "long_words")


def features(data: np.ndarray, off: np.ndarray, lexicon: np.ndarray, person: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def count(mask: np.ndarray) -> np.ndarray:
        return per_doc(mask, off)

    start, end, doc = find_words(data, off, _WORD_END)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    spans = Spans(LOWER[data])
    h = spans.hash(start, end)
    hit, you = member(h, lexicon), member(h, person)
    stem = np.zeros(len(h), bool)
    for which, s in stem_hashes(spans, start, end):
        stem[which] |= member(s, lexicon)
    stems = np.bincount(doc[stem], minlength=n)
    hits = np.bincount(doc[hit], minlength=n)
    pairs = np.unique(np.stack((doc[hit].astype(np.uint64), h[hit])), axis=1) if hit.any() else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    place = np.flatnonzero(you)
    at = np.flatnonzero(hit)
    near = np.zeros(len(at), bool)
    if len(place) and len(at):
        i = np.searchsorted(place, at)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(place) - 1)):
            near |= (np.abs(place[j] - at) <= NEAR) & (doc[place[j]] == doc[at])
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    all_caps = (upper[end] - upper[start] == end - start) & (end - start > 1)
    # Words between spaces: letters with digits, signs or fillers inside.
    s2, e2, d2 = find_words(data, off)
    letters = np.concatenate(([0], np.cumsum(_LETTERS[data])))
    odd = np.zeros(256, bool)
    odd[[*_LEET, *map(ord, _FILLER)]] = True
    inner = np.concatenate(([0], np.cumsum(odd[data])))
    odd_in = inner[np.maximum(e2 - 1, s2)] - inner[np.minimum(s2 + 1, e2)]
    disguised = (odd_in > 0) & (letters[e2] - letters[s2] >= 2) & (e2 - s2 <= 20)
    disguised_hits = np.zeros(n)
    if disguised.any():
        # Fillers go, stand-ins become letters; what is then a word of the lexicon was hidden.
        ds, de, dd = s2[disguised], e2[disguised], d2[disguised]
        size_ = de - ds
        at_ = np.repeat(ds - np.concatenate(([0], np.cumsum(size_)[:-1])), size_) + np.arange(size_.sum())
        part = data[at_]
        filler = np.zeros(256, bool)
        filler[list(map(ord, _FILLER + ",;:\"'()?"))] = True
        keep = ~filler[part]
        owner = np.repeat(np.arange(len(ds)), size_)[keep]
        bounds = np.searchsorted(owner, np.arange(len(ds) + 1))
        hh = Spans(_PLAIN[part[keep]]).hash(bounds[:-1], bounds[1:])
        disguised_hits = np.bincount(dd[member(hh, lexicon)], minlength=n)
    signs = ~(_LETTERS | _DIGITS | (_BYTES <= 32))
    sign = signs[data]
    doubled = np.concatenate((sign[1:] & (data[1:] == data[:-1]), [False])) if len(data) else sign
    cols = [
        stems,
        stems / words,
        hits + disguised_hits,
        distinct,
        (hits + disguised_hits) / words,
        np.bincount(doc[at][near], minlength=n),
        np.bincount(doc[you], minlength=n) / words,
        count(_UPPER[data]) / size,
        np.bincount(doc[all_caps], minlength=n) / words,
        count(data == 33) / size,
        count(data == 63) / size,
        count(sign) / size,
        count(doubled) / size,
        count(_DIGITS[data]) / size,
        np.bincount(d2[disguised], minlength=n) / words,
        disguised_hits,
        np.log1p(np.bincount(doc, minlength=n)),
        np.bincount(doc[end - start > 15], minlength=n) / words,
    ]
    return np.stack(cols, 1).astype(np.float64)


@dataclass
class ToxicityModel:
    lexicon: np.ndarray
    person: np.ndarray
    edges: list
    trees: list
    base: float
    steps: np.ndarray  # raw scores at which the calibrated one changes
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += RATE * _walk(tree, binned)
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def _walk(tree: list, binned: np.ndarray) -> np.ndarray:
    """tree: (feature, last bin of the left side, value) by heap index; feature -1 is a leaf."""
    feature, cut, value = (np.array(c) for c in zip(*tree))
    node = np.zeros(len(binned), np.int64)
    for _ in range(DEPTH):
        f = feature[node]
        right = binned[np.arange(len(binned)), np.maximum(f, 0)] > cut[node]
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return value[node]


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
    """A tree by second-order gains over binned features."""
    n_nodes = 2 ** (DEPTH + 1) - 1
    tree = [(-1, 0, 0.0)] * n_nodes
    node = np.zeros(len(g), np.int64)
    for k in range(n_nodes):
        rows = np.flatnonzero(node == k)
        if not len(rows):
            continue
        gs, hs = g[rows].sum(), h[rows].sum()
        tree[k] = (-1, 0, -gs / (hs + 1.0))
        if 2 * k + 2 >= n_nodes or len(rows) < 2 * LEAST_LEAF:
            continue
        best = (1e-6, -1, 0)
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gl, hl = np.cumsum(np.bincount(b, g[rows], BINS + 1)), np.cumsum(np.bincount(b, h[rows], BINS + 1))
            nl = np.cumsum(np.bincount(b, minlength=BINS + 1))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], f, c)
        if best[1] >= 0:
            tree[k] = (best[1], best[2], 0.0)
            node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
    return tree


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and fitted level of each pool, ascending."""
    order = np.argsort(x, kind="stable")
    pools: list = []
    for a, b, w in zip(x[order], y[order], weight[order]):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lexicon: np.ndarray, person: np.ndarray, calib: np.ndarray | None = None) -> ToxicityModel:
    """Trees on the rows that aren't for calibration, isotonic steps on those that are (none: on all); weight undoes the sampling by class."""
    calib = np.zeros(len(y), bool) if calib is None else calib
    fit_ = ~calib
    edges = [np.unique(np.quantile(x[fit_, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = ToxicityModel(lexicon, person, edges, [], 0.0, np.zeros(1), np.zeros(1))
    binned = np.stack([np.searchsorted(e, x[fit_, j], "left") for j, e in enumerate(edges)], 1)
    yt, wt = y[fit_], weight[fit_]
    mean = np.clip((yt * wt).sum() / wt.sum(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(mean / (1 - mean)))
    z = np.full(len(yt), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(binned, (p - yt) * wt, p * (1 - p) * wt)
        model.trees.append(tree)
        z += RATE * _walk(tree, binned)
    use = calib if calib.any() else fit_
    raw = model.raw(x[use])
    model.steps, model.levels = isotonic(raw, y[use].astype(float), weight[use])
    return model


def for_calibration() -> Column:
    """Whether a row of the sample is for calibration."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(77)), F.lit(4)) == 3


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Learns lexicon, trees and calibration from a bounded sample of the labelled rows that aren't held out; None if there is none.

    Calibration has rows of its own (a quarter, by a hash of the id): neither lexicon nor trees learn from them. A sample of under LEAST_SPLIT rows isn't split.
    """
    rows, chosen = labelled_sample(docs, labels, "toxic", 4, 2, PER_CLASS, SAMPLE, 5)
    chosen = materialise(chosen.withColumn("calibration", for_calibration()))
    sizes = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
    if not sizes:
        discard(chosen)
        return None
    learning = chosen.filter("NOT calibration") if sum(sizes.values()) >= LEAST_SPLIT else chosen
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}

    def words(batches):
        for b in blocks(batches):
            data, off = utf8(b.column("text"))
            start, end, doc = find_words(data, off, _WORD_END)
            spans = Spans(LOWER[data])
            all_ = [(np.arange(len(start)), spans.hash(start, end)), *stem_hashes(spans, start, end)]
            doc, h = np.concatenate([doc[w] for w, _ in all_]), np.concatenate([x for _, x in all_])
            pair = np.unique(np.stack((doc.astype(np.uint64), h)), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()).take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64))], ["label", "word"])

    learned_from = {r[0]: r[1] for r in learning.groupBy("label").count().collect()}
    toxic, clean = max(1, learned_from.get(1, 0)), max(1, learned_from.get(0, 0))
    usual = toxic / (toxic + clean)
    share = (F.col("t") / toxic) / (F.col("t") / toxic + (F.col("c") + 0.5) / clean)
    seen = F.col("t") + F.col("c")
    evidence = F.col("t") * F.log(F.col("t") / seen / usual) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / seen / (1 - usual))).otherwise(0.0)
    learned = (
        learning.select("label", "text").mapInArrow(words, "label int, word long")
        .groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        .filter(F.col("t") > 0).filter((evidence >= LEAST_EVIDENCE) & (share >= LEAST_SHARE))
        .orderBy(F.desc(evidence), "word").limit(LEXICON).collect()
    )
    person = word_hashes(SECOND_PERSON)
    lexicon = np.unique(np.concatenate((word_hashes(SEEDS), np.array([r["word"] for r in learned], np.int64).view(np.uint64))))

    def rows_of(batches):
        for b in blocks(batches):
            x = features(*utf8(b.column("text")), lexicon, person)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), b.column("calibration"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "calibration", "x"])

    got = chosen.select(F.col("doc_id").cast("long"), "label", "calibration", "text").mapInArrow(rows_of, "doc_id long, label int, calibration boolean, x array<double>").collect()
    discard(chosen)
    got.sort(key=lambda r: (r[0], r[1], r[3]))
    y = np.array([r[1] for r in got])
    weight = np.where(y == 1, totals.get(1, 0) / max(1, sizes.get(1, 0)), totals.get(0, 0) / max(1, sizes.get(0, 0)))
    calib = np.array([r[2] for r in got]) & (len(got) >= LEAST_SPLIT)
    return fit(np.array([r[3] for r in got]), y, weight / weight.mean(), lexicon, person, calib)


def _predict(model: ToxicityModel | None, texts) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return np.clip(model.score(features(*utf8(texts), model.lexicon, model.person)), 0.0, 1.0)


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each whole text; null counts as empty. Without a model all get 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON words and TREES trees

    def run(batches):
        for b in blocks(batches):
            p = _predict(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(4, 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows whose text scores below THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in blocks(batches):
            yield b.filter(pa.array(_predict(shared.value, b.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, learned from labelled ones not held out: doc_id, held_out, score, predicted. Null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

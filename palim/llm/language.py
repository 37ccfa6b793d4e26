"""Language identification in two levels: the family first, then one-versus-one linear machines within it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.llm.common import blocks, bounded_sample, held_out, utf8

DIMS = 4096
#: Bound of the training sample: documents of a language, and of all.
PER_LANGUAGE, SAMPLE = 1000, 4000
#: Families of common language codes; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi bn ur pa mr gu ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")


def features(texts: pa.Array) -> np.ndarray:
    """Hashed byte 1- to 4-grams of the lower-cased text: square roots of relative counts, so rows have length 1."""
    data, off = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(off) - 1
    out = np.zeros(n * DIMS)
    doc = np.repeat(np.arange(n) * DIMS, np.diff(off))
    wide = data.astype(np.uint32)
    key = np.zeros(len(data), np.uint32)
    for order in range(1, 5):
        m = len(data) - order + 1
        if m <= 0:
            break
        key = key[:m] * np.uint32(0x01000193) + wide[order - 1 :] + np.uint32(order)
        slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(20)
        inside = doc[:m] == doc[order - 1 :]
        out += np.bincount((doc[:m] + slot)[inside], minlength=n * DIMS)
    out = out.reshape(n, DIMS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class LanguageModel:
    families: list = field(default_factory=list)
    members: dict = field(default_factory=dict)  # family -> languages
    family_weights: np.ndarray | None = None  # (DIMS + 1, families)
    duels: dict = field(default_factory=dict)  # (a, b) -> weights; positive: a

    def predict(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        logits = x @ self.family_weights
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        first = p.argmax(1)
        lang, score = [None] * len(x), p.max(1)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(first == f)
            names = self.members[family]
            if not len(rows):
                continue
            votes, least = np.zeros((len(rows), len(names))), np.ones((len(rows), len(names)))
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    margin = x[rows] @ self.duels[a, names[j]]
                    q = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
                    votes[:, i] += (q >= 0.5) + q * 1e-3
                    votes[:, j] += (q < 0.5) + (1 - q) * 1e-3
                    least[:, i] = np.minimum(least[:, i], q)
                    least[:, j] = np.minimum(least[:, j], 1 - q)
            best = votes.argmax(1)
            score[rows] *= least[np.arange(len(rows)), best]
            for r, b in zip(rows, best):
                lang[r] = names[b]
        return lang, score


def _machine(x: np.ndarray, y: np.ndarray, c: float = 30.0, steps: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; y is +1 or -1, classes weigh the same."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step, c = np.float32(1 / (1 + 4 * c)), np.float32(c)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * (x.T @ (weight * y * slack)))
        w, v = new, new + np.float32(t / (t + 3)) * (new - w)
    return w.astype(np.float32)


def _softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 200) -> np.ndarray:
    """Multinomial logistic regression, classes weighing the same."""
    w = v = np.zeros((x.shape[1], k), np.float32)
    hot = np.eye(k, dtype=np.float32)[y]
    weight = ((1 / np.bincount(y, minlength=k).clip(1))[y] / k).astype(np.float32)
    step, ridge = np.float32(4), np.float32(1e-4)
    for t in range(steps):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - step * (x.T @ ((p - hot) * weight[:, None]) + ridge * v)
        w, v = new, new + np.float32(t / (t + 3)) * (new - w)
    return w.astype(np.float32)


def train(rows: DataFrame) -> LanguageModel | None:
    """rows: doc_id, text, lang. Learns from a bounded sample; None if no row has a language and a letter."""

    def run(batches):
        for b in blocks(batches):
            x = features(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    got = bounded_sample(rows, "lang", PER_LANGUAGE, SAMPLE, 2).select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1]))
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32)
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    lang = np.array([r[0] for r in got])
    model = LanguageModel()
    for name in sorted(set(lang)):
        model.members.setdefault(_FAMILY.get(name.split("-")[0].lower(), f"other {name}"), []).append(name)
    model.families = sorted(model.members)
    of = {m: f for f, family in enumerate(model.families) for m in model.members[family]}
    model.family_weights = _softmax(x, np.array([of[v] for v in lang]), len(model.families))
    for names in model.members.values():
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                rows_ = (lang == a) | (lang == b)
                model.duels[a, b] = _machine(x[rows_], np.where(lang[rows_] == a, 1.0, -1.0))
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each whole text. `und` with score 0: null text, no letter, or no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (DIMS + 1) * (families + pairs) floats

    def run(batches):
        model = shared.value
        for b in blocks(batches):
            texts = b.column("text")
            if model is None:
                lang, score = [None] * b.num_rows, np.zeros(b.num_rows)
            else:
                lang, score = model.predict(features(texts))
            lettered = [t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()]
            lang = [v if ok and v else "und" for v, ok in zip(lang, lettered)]
            score = np.where([v != "und" for v in lang], score, 0.0).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, learned from those not held out: doc_id, held_out, lang_pred, score. Null texts and those without a letter: und, 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs.filter(~held_out(5, 0)).select("doc_id", "text", "lang")))

"""A bigram language model in sharded Elias-Fano tries.

p(w | v) = (c(v w) + K p1(w)) / (c(v) + K) with p1(w) = (c(w) + 1) / (N + V + 1). Its logarithm is a sum of
terms of single keys, so that each key can be looked up where it is stored:

    log p1(w) + log(K / (c(v) + K)) + log(1 + c(v w) / (K p1(w)))

The last term, quantised, is what a trie holds for a seen pair. A trie is keyed by the word, then by the
words before it: level 1 has the words (exact counts beside them), pointers into level 2 are monotone, and
level 2 has the predecessors of each word, as ranks among the predecessors of the shard (a level of their own), found by
successor search within the word's range. So a pair is seen if both words are equal in all 64 bits. Each shard's levels
are one file in the shared folder, mapped into memory where the folder is mounted.

K is the weight under which the training rows are likeliest if each token is left out of the counts in turn.

Words above a share of 1 / HOT of the tokens (HOT words at most, a proven bound) are broadcast with their counts; their
pairs are dealt out by pair, all others by word, so no key outweighs a shard. Pairs above that share are broadcast too.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.llm.common import (
    block_bytes, blocks, discard, group_bounds, held_out, is_member, materialise, mix, pack, range_shard, shared_folder, shuffles_end_with_the_query, unpack, utf8, word_hashes,
)
from palim.llm.elias_fano import EliasFano

#: Smoothing weights to choose from; leave-one-out likelihood of the training rows chooses.
WEIGHTS = 2.0 ** np.arange(2, 15)
#: Tokens of a shard, and shards at most: what one task counts.
SHARD_TOKENS, SHARDS = 2_000_000, 100_000
#: Steps of a quantised pair term, in log10 (wider if the largest term needs it), and codes.
STEP, CODES = 0.03, 255
HOT = 50_000
BLOCK, DOCS = 3 << 20, 60_000
_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_PARTS = 5


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hash, hash of the token before, document: the words of each document with A-Z lowered, then one end."""
    (word,), doc = word_hashes(data, off, lower=True)
    n = len(off) - 1
    at = np.arange(len(word)) + doc
    size = np.bincount(doc, minlength=n) + 1
    ends = np.cumsum(size) - 1
    out, docs = np.full(len(word) + n, _END), np.repeat(np.arange(n), size)
    out[at] = word
    before = np.concatenate(([_START], out[:-1]))
    before[np.concatenate(([0], ends[:-1] + 1))[:n]] = _START
    return out, before, docs


def _before(at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Indices of predecessors among the hot words, from those of the words; the start is none."""
    out = np.concatenate((at[:1], at[:-1]))
    out[before == _START] = -1
    return out


def count_code(count: np.ndarray) -> np.ndarray:
    """A count in a byte: exact up to 128, then in steps of 1/16 of a doubling (of 1/2 from 2**12 on)."""
    x = np.log2(np.maximum(count, 1))
    return np.where(count <= 128, count, np.where(x <= 12, 128 + np.rint((x - 7) * 16), np.minimum(208 + np.rint((x - 12) * 2), 255))).astype(np.uint8)


#: What each code stands for.
_COUNTS = np.concatenate((np.arange(129), 2.0 ** (7 + np.arange(1, 81) / 16), 2.0 ** (12 + np.arange(1, 48) / 2)))


class Trie:
    """The levels of one shard: words, pointers into pairs, predecessors of the shard, pairs."""

    def __init__(self, words: EliasFano, pointers: EliasFano, vocabulary: EliasFano, before: EliasFano, counts: np.ndarray, codes: np.ndarray):
        self.words, self.pointers, self.vocabulary, self.before, self.counts, self.codes = words, pointers, vocabulary, before, counts, codes
        self.bits = np.uint64(max(0, vocabulary.n - 1).bit_length())

    @classmethod
    def build(cls, word: np.ndarray, before: np.ndarray, totals: np.ndarray, codes: np.ndarray) -> Trie:
        """Pairs sorted by word and predecessor; totals: the count of each distinct word."""
        bounds = group_bounds(word)
        ordinal = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        vocabulary, rank = np.unique(before.astype(np.uint64), return_inverse=True)
        bits = max(0, len(vocabulary) - 1).bit_length()
        return cls(
            EliasFano.build(word[bounds[:-1]], 1 << 64),
            EliasFano.build(bounds.astype(np.uint64), len(word) + 1),
            EliasFano.build(vocabulary, 1 << 64),
            EliasFano.build((ordinal << np.uint64(bits)) | rank.astype(np.uint64), max(1, len(bounds) - 1) << bits),
            totals, codes,
        )

    def to_bytes(self) -> bytes:
        """A head with the size of each part, then the parts, each at a multiple of 8 bytes."""
        parts = [p for level in (self.words, self.pointers, self.vocabulary, self.before) for p in level.parts()] + [self.counts.astype(np.uint64), self.codes.astype(np.uint8)]
        raw = [np.ascontiguousarray(p).tobytes() for p in parts]
        return np.array([len(r) for r in raw], np.uint64).tobytes() + b"".join(r + bytes(-len(r) % 8) for r in raw)

    @classmethod
    def of(cls, mapped: np.ndarray) -> Trie:
        n = 4 * _PARTS + 2
        sizes, at, parts = mapped[: 8 * n].view(np.uint64).astype(np.int64), 8 * n, []
        for i, size in enumerate(sizes):
            part = mapped[at : at + size]
            parts.append(part if i == n - 1 else part.view(np.uint64))
            at += size + -size % 8
        return cls(*(EliasFano.of(*parts[_PARTS * i : _PARTS * (i + 1)]) for i in range(4)), parts[-2], parts[-1])

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinal (or -1) and count of each word."""
        at = self.words.find(words)
        return at, np.where(at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0).astype(np.int64)

    def ranks(self, before: np.ndarray) -> np.ndarray:
        """The rank of each predecessor, -1 if the shard has none like it."""
        known, back = np.unique(before.astype(np.uint64), return_inverse=True)
        return self.vocabulary.find(known)[back]

    def gains(self, ordinal: np.ndarray, which: np.ndarray, rank: np.ndarray, step: float = STEP) -> np.ndarray:
        """For pairs of word ordinal[which] and predecessor (by rank): the quantised term, 0 if unseen."""
        out = np.zeros(len(rank))
        if not self.before.n:
            return out
        first, end = (self.pointers.access(np.maximum(ordinal, 0) + i).astype(np.int64) for i in (0, 1))
        some = np.flatnonzero((ordinal[which] >= 0) & (rank >= 0))
        o = which[some]
        at = self.before.find((ordinal[o].astype(np.uint64) << self.bits) | rank[some].astype(np.uint64), first[o], end[o])
        out[some] = np.where(at >= 0, self.codes[np.maximum(at, 0)] * step, 0)
        return out


def _write(path: str, content: bytes) -> None:
    """Whole or not at all; a second attempt writes the same."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, at)


def _open(path: str) -> Trie:
    """A trie that was written; one that isn't there is an error, not an empty one."""
    parsed = urllib.parse.urlparse(path)
    if parsed.scheme in ("", "file"):
        return Trie.of(np.memmap(parsed.path, np.uint8, "r"))
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return Trie.of(np.frombuffer(f.read_buffer(), np.uint8))


def _by_shard(shards: int, at: np.ndarray, at_before: np.ndarray, word: np.ndarray, before: np.ndarray, *more: np.ndarray):
    """Deals out pairs; at, at_before: indices of words and predecessors among the hot words, or -1. Gives, for each shard that gets any, (shard, cold part, hot part).

    Cold part: words, pairs of each word, predecessors, and more; hot part: index of the word, predecessors, and more.
    Predecessors are bits that say which are hot, the indices of those, and the hashes of the others.
    """
    warm = np.flatnonzero(at >= 0)
    route = range_shard(mix(word[warm] ^ (before[warm] * np.uint64(0x9E3779B97F4A7C15))), shards)
    order = np.argsort(route, kind="stable")
    warm, warm_bounds = warm[order], np.searchsorted(route[order], np.arange(shards + 1))
    cold = np.flatnonzero(at < 0)
    cold = cold[np.argsort(word[cold], kind="stable")]
    cold_bounds = np.searchsorted(range_shard(word[cold], shards), np.arange(shards + 1))

    def predecessors(which: np.ndarray) -> tuple:
        known = at_before[which] >= 0
        return np.packbits(known), at_before[which[known]].astype(np.uint16), before[which[~known]]

    for s in np.flatnonzero((np.diff(warm_bounds) > 0) | (np.diff(cold_bounds) > 0)).tolist():
        c, h = cold[cold_bounds[s] : cold_bounds[s + 1]], warm[warm_bounds[s] : warm_bounds[s + 1]]
        bounds = group_bounds(word[c])
        yield s, (word[c][bounds[:-1]], np.diff(bounds).astype(np.uint32), *predecessors(c), *(m[c] for m in more)), (at[h].astype(np.uint16), *predecessors(h), *(m[h] for m in more))


def _unpack_pairs(payload, kind) -> tuple:
    """Of pack(*cold, *hot) of _by_shard with one more column: words, pairs of each, predecessors, more; indices, predecessors, more. Predecessors: which are hot, indices of those, the others."""
    cw, cn, cf, ch, cb, cm, hw, hf, hh, hb, hm = unpack(payload, np.uint64, np.uint32, np.uint8, np.uint16, np.uint64, kind, np.uint16, np.uint8, np.uint16, np.uint64, kind)
    return cw, cn, (np.unpackbits(cf, count=len(cm)).astype(bool), ch, cb), cm, hw, (np.unpackbits(hf, count=len(hm)).astype(bool), hh, hb), hm


def _filled(predecessors: tuple, hot_values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """One array from the values of the hot words and those of the others, in the order of the pairs."""
    known, index, _ = predecessors
    out = np.empty(len(known), others.dtype)
    out[known], out[~known] = hot_values[index], others
    return out


def _count_words(batches):
    for b in blocks(batches, size=BLOCK, docs=DOCS):
        word, _, _ = tokens(*utf8(b.column("text")))
        word, n = np.unique(word, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


class Model:
    """Where the tries are, the totals, and what is broadcast: at most HOT words and HOT pairs."""

    def __init__(self, folder: str, shards: int, n: int, v: int, hot: np.ndarray, hot_counts: np.ndarray):
        self.folder, self.shards, self.n, self.v, self.hot, self.hot_counts = folder, shards, n, v, hot, hot_counts
        self.ends = 0  # training texts
        self.weight = 1.0  # K
        self.built = np.zeros(shards, bool)  # shards that have a trie
        self.pairs, self.pair_gains = np.zeros(0, np.uint64), np.zeros(0)

    def path(self, shard: int, smoothed: bool = False) -> str:
        return f"{self.folder}/{'tries' if smoothed else 'counts'}/{shard:06d}.ef"

    @property
    def step(self) -> float:
        """No term is larger than that of a word all of whose occurrences follow one word: the codes reach as far."""
        return max(STEP, float(np.log10(1 + (self.n + self.v + 1) / self.weight)) / CODES)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def context(self, count: np.ndarray) -> np.ndarray:
        return np.log10(self.weight / (count + self.weight))

    def gain(self, pair_count: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of 1 + c(v w) / (K p1(w))."""
        return np.log10(1 + pair_count * ((self.n + self.v + 1) / (self.weight * (count + 1))))

    def quantised(self, pair_count: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(self.gain(pair_count, count) / self.step), CODES).astype(np.uint8)


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(word + before * np.uint64(0xD1342543DE82EF95))


def _trie_of(model: Model, payloads: list) -> tuple[Trie, tuple, np.ndarray]:
    """Joins the counted pairs of a shard (codes: counts); also key, count and word count of its frequent pairs, and their part of the likelihood for each weight."""
    words, befores, counts = [], [], []
    for p in payloads:
        cw, cn, cb, cc, hw, hb, hc = _unpack_pairs(p, np.uint32)
        words += [np.repeat(cw, cn), model.hot[hw]]
        befores += [_filled(cb, model.hot, cb[2]), _filled(hb, model.hot, hb[2])]
        counts += [cc, hc]
    word, before, count = np.concatenate(words), np.concatenate(befores), np.concatenate(counts).astype(np.int64)
    order = np.lexsort((before, word))
    word, before, count = word[order], before[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (before[1:] != before[:-1]))) if len(word) else np.zeros(0, bool))
    count = np.add.reduceat(count, first) if len(first) else count
    word, before = word[first], before[first]
    bounds = group_bounds(word)
    totals = np.add.reduceat(count, bounds[:-1]) if len(word) else count
    at = is_member(word[bounds[:-1]], model.hot)
    totals = np.where(at >= 0, model.hot_counts[np.maximum(at, 0)] if len(model.hot) else 0, totals)
    total = np.repeat(totals, np.diff(bounds))
    often = count >= max(1, model.n / HOT)
    share = total / (model.n + model.v)
    likelihood = np.array([(count * np.log(count - 1 + k * share)).sum() for k in WEIGHTS])
    return Trie.build(word, before, totals, count_code(count)), (pair_key(word[often], before[often]), count[often], total[often]), likelihood


def _grouped(batches):
    """(shard, payloads) for rows that come sorted by shard."""
    held, shard = [], None
    for batch in batches:
        for s, p in zip(batch.column("shard").to_pylist(), batch.column("payload")):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append(p.as_buffer())
    if held:
        yield shard, held


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """A shard to each partition."""
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def train(docs: DataFrame) -> Model:
    """Counts every token and pair of docs (doc_id, text; null text counts as empty) and writes the tries."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")
    counted = materialise(texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # What contexts take from the likelihood, for each weight; the end is no context, and texts begin as often as they end.
    end = F.col("word") == int(_END.view(np.int64))
    taken = [F.coalesce(F.sum(F.when(~end, F.col("n") * F.log(F.col("n") - 1 + float(k)))), F.lit(0.0)) for k in WEIGHTS]
    n, v, ends, *taken = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0)), *taken).first()
    rows = counted.filter(F.col("n") >= max(1.0, n / HOT)).collect()
    discard(counted)
    hot = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hot)
    shards = min(SHARDS, max(partitions, -(-n // SHARD_TOKENS)))
    model = Model(shared_folder(spark), shards, n, v, hot[order], np.array([r["n"] for r in rows], np.int64)[order])
    model.ends = ends
    size = max(BLOCK, block_bytes(shards))
    shared = spark.sparkContext.broadcast(model)

    def pairs(batches):
        model = shared.value
        for b in blocks(batches, size=size, docs=DOCS):
            word, before, _ = tokens(*utf8(b.column("text")))
            key = pair_key(word, before)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            at = is_member(word, model.hot)
            got = list(_by_shard(model.shards, at[first], _before(at, before)[first], word[first], before[first], n.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in got], pa.int32()), pa.array([pack(*c, *h) for _, c, h in got], pa.binary())], ["shard", "payload"])

    def build(batches):
        """Tries with counts as codes; rows: the likelihood of each shard (its number as n), and frequent pairs."""
        model = shared.value
        for shard, payloads in _grouped(batches):
            trie, (keys, counts, totals), likelihood = _trie_of(model, payloads)
            _write(model.path(shard), trie.to_bytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([shard], pa.int64()), pa.nulls(1, pa.int64()), pa.array([likelihood.tolist()], pa.list_(pa.float64()))], _BUILT)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(totals), pa.nulls(len(keys), pa.list_(pa.float64()))], _BUILT)

    with shuffles_end_with_the_query(spark):
        built = _dealt(texts.mapInArrow(pairs, "shard int, payload binary"), shards).mapInArrow(build, "pair long, n long, total long, likelihood array<double>").collect()  # a row for each shard, and at most HOT
    likelihood = sum((np.array(r["likelihood"]) for r in built if r["pair"] is None), -np.array(taken, float) - model.ends * np.log(np.maximum(model.ends - 1, 0) + WEIGHTS))
    model.built[[r["n"] for r in built if r["pair"] is None]] = True
    model.weight = float(WEIGHTS[int(np.argmax(likelihood))])
    frequent = sorted((r["pair"] & (1 << 64) - 1, r["n"], r["total"]) for r in built if r["pair"] is not None)
    keys, counts, totals = (np.array([f[i] for f in frequent], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    model.pairs, model.pair_gains = keys, model.quantised(counts, totals) * model.step
    weighted = spark.sparkContext.broadcast(model)

    def smooth(batches):
        """Counts become quantised terms; a second attempt finds the file as it was or done, by its name."""
        model = weighted.value
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                if model.built[shard]:
                    trie = _open(model.path(shard))
                    size = np.diff(trie.pointers.access(np.arange(trie.words.n + 1)).astype(np.int64)) if trie.words.n else np.zeros(0, np.int64)
                    trie.codes = model.quantised(_COUNTS[trie.codes], np.repeat(trie.counts.astype(np.int64), size))
                    _write(model.path(shard, True), trie.to_bytes())
            yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"])

    spark.range(0, shards, 1, min(shards, partitions)).mapInArrow(smooth, "id long").write.format("noop").mode("overwrite").save()
    _remove(spark, os.path.dirname(model.path(0)))
    return model


_BUILT = ["pair", "n", "total", "likelihood"]


def _remove(spark, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of each whole text.

    Null text counts as empty: one token, the end. Rows are scored one by one, repeated or with a null id. An empty
    training set leaves every token unknown at 1 / (0 + 0 + 1), so all scores are 0.

    A block of documents asks each shard once and gets one packed answer from it; the answers of a block meet again
    beside what was known at once. Rows are those of blocks and shards, not of tokens.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = max(BLOCK, block_bytes(model.shards))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), held_out(7, 2).alias("held_out"), "text")

    def ask(batches):
        """Rows for shards, and one for each block with what is known here. A block is named by its first row."""
        m = shared.value
        start = float(m.context(m.ends))
        for b in blocks(batches, size=size, docs=DOCS):
            n, block = b.num_rows, b.column("uid")[0].as_py()
            word, before, doc = tokens(*utf8(b.column("text")))
            at = is_member(word, m.hot)
            warm = np.flatnonzero(at >= 0)
            count = m.hot_counts[at[warm]] if len(warm) else np.zeros(0, np.int64)
            base = m.base(count)
            context = np.where(word[warm] == _END, 0.0, m.context(count))
            frequent = is_member(pair_key(word, before), m.pairs)
            known = np.flatnonzero(frequent >= 0)
            total = np.bincount(doc[warm], base + context, minlength=n) + np.bincount(doc[known], m.pair_gains[frequent[known]], minlength=n) + start
            ids = b.column("doc_id")
            here = pack(
                ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False), np.bincount(doc, minlength=n).astype(np.int64),
                np.bincount(doc[warm], minlength=n).astype(np.int64), np.bincount(doc[warm], base, minlength=n), total,
            )
            rest = np.flatnonzero(frequent < 0)
            asked = [(s, pack(*c, *h)) for s, c, h in _by_shard(m.shards, at[rest], _before(at, before)[rest], word[rest], before[rest], doc[rest].astype(np.uint16))]
            names = [s for s, _ in asked] + [block % m.shards]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()), pa.array([True] * len(asked) + [False]), pa.array([p for _, p in asked] + [here], pa.binary())], ["shard", "block", "asks", "payload"])

    def answer(batches):
        m, trie, shard = shared.value, None, None
        for batch in batches:
            shards_, blocks_, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "block", "asks"))
            payloads = batch.column("payload")
            out = [(int(blocks_[i]), True, payloads[i].as_py()) for i in np.flatnonzero(~asks)]
            some = np.flatnonzero(asks)
            bounds = group_bounds(shards_[some])
            for a, z in zip(bounds[:-1], bounds[1:]):  # the questions of one shard are looked up together
                if shards_[some[a]] != shard:
                    shard = shards_[some[a]]
                    trie = _open(m.path(shard, True)) if m.built[shard] else None
                asked_ = [_unpack_pairs(payloads[int(i)].as_buffer(), np.uint16) for i in some[a:z]]
                for i, found in zip(some[a:z], _answers(m, trie, asked_)):
                    out.append((int(blocks_[i]), False, found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["block", "own", "payload"])

    def add(batches):
        """The answers of each block on top of its own sums; its own row comes first."""
        own, block = None, None
        for batch in batches:
            for name, first, p in zip(batch.column("block").to_pylist(), batch.column("own").to_pylist(), batch.column("payload")):
                if first:
                    if own is not None:
                        yield finished(own)
                    block, own = name, [x.copy() for x in unpack(p.as_buffer(), np.int64, np.bool_, np.bool_, np.int64, np.int64, np.float64, np.float64)]
                    continue
                assert name == block
                present, known, base, total = unpack(p.as_buffer(), np.uint16, np.uint32, np.float64, np.float64)
                own[4][present] += known
                own[5][present] += base
                own[6][present] += total
        if own is not None:
            yield finished(own)

    def finished(own: list) -> pa.RecordBatch:
        ids, valid, held, n_tokens, known, base, total = own
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), *map(pa.array, (held, n_tokens, known, np.full(len(ids), model_tokens), base, total))], _SCORED)

    model_tokens = model.n
    shards = model.shards
    asked = rows.mapInArrow(ask, "shard int, block long, asks boolean, payload binary")
    answered = _dealt(asked, shards).mapInArrow(answer, "block long, own boolean, payload binary")
    return answered.repartition(shards, "block").sortWithinPartitions("block", F.desc("own")).mapInArrow(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _answers(m: Model, trie: Trie | None, asked: list) -> list[bytes]:
    """For each question of one shard: its documents, their known tokens, and their sums of both scores, packed."""
    cw, cn, cd, hw, hd = (np.concatenate([q[i] for q in asked]) for i in (0, 1, 3, 4, 6))
    cb, hb = (tuple(np.concatenate([q[i][j] for q in asked]) for j in range(3)) for i in (2, 5))

    def documents(i: int) -> np.ndarray:
        """Documents, told apart by question."""
        return np.concatenate([q[i].astype(np.int64) + (j << 16) for j, q in enumerate(asked)])

    which = np.repeat(np.arange(len(cw)), cn)
    if trie is None:
        count, gain = np.zeros(len(cw), np.int64), np.zeros(len(cd) + len(hd))
    else:
        ordinal, count = trie.look_up(cw)
        warm, back = np.unique(hw, return_inverse=True)
        hot_ranks = trie.vocabulary.find(m.hot)
        others = trie.ranks(np.concatenate((cb[2], hb[2])))
        ranks = [_filled(x, hot_ranks, y) for x, y in zip((cb, hb), np.split(others, [len(cb[2])]))]
        gain = np.concatenate((trie.gains(ordinal, which, ranks[0], m.step), trie.gains(trie.words.find(m.hot[warm]), back, ranks[1], m.step)))
    base = m.base(count)
    context = np.where(cw == _END, 0.0, m.context(count))
    present, place = np.unique(np.concatenate((documents(3), documents(6))), return_inverse=True)
    cold, n = place[: len(cd)], len(present)
    known = np.bincount(cold, count[which] > 0, minlength=n).astype(np.uint32)
    sums = np.bincount(cold, base[which], minlength=n), np.bincount(cold, (base + context)[which], minlength=n) + np.bincount(place, gain, minlength=n)
    bounds = np.searchsorted(present, np.arange(len(asked) + 1) << 16)
    return [pack((present[a:z] & 0xFFFF).astype(np.uint16), known[a:z], sums[0][a:z], sums[1][a:z]) for a, z in zip(bounds[:-1], bounds[1:])]


_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op6_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, the model being of those that aren't held out: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs.filter(~held_out(7, 2))))

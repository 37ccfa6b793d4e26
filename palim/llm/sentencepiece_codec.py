"""Encoding and decoding with a SentencePiece model of the BPE kind.

The lattice is relational, in array form inside each task: distinct words (a run of spaces and what follows it) of a
block are exploded into spans of bounded length, spans meet the piece table by hash, and the edges of a word
are folded into its pieces. A BPE model's segmentation isn't its best-scoring path, so the fold joins the best-scored
pair of neighbours until no edge spans two of them, as such a model defines; words repeat, so each is folded once a block.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palim.llm.common import Spans, blocks, group_bounds, is_member, utf8

BLOCK, DOCS = 2 << 20, 20_000
#: Characters up to which words are folded together in arrays; longer ones go one by one through a heap.
LONG = 48
_MARK = "▁".encode()  # stands for a space in pieces; here a space is a space
_NONE = np.int64(1 << 30)


@dataclass
class Pieces:
    """The piece table: hashes ascending, ids and ranks (0: joined first) beside them."""

    hashes: np.ndarray
    ids: np.ndarray
    ranks: np.ndarray
    widest: int
    byte_ids: np.ndarray
    unknown: int
    text: np.ndarray  # the bytes of all pieces by id, one after another
    text_off: np.ndarray

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain, texts, byte_ids = [], [], np.full(256, model.unk_id(), np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.encode().replace(_MARK, b" "))
                plain.append((model.get_score(i), i))
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        ids = np.array([i for _, i in plain], np.int64)
        # Equal scores are of equal rank: the leftmost pair goes first.
        ranks = np.unique(-np.array([s for s, _ in plain]), return_inverse=True)[1].astype(np.int64)
        hashes = Spans(data).hash(off[ids], off[ids + 1])
        order = np.argsort(hashes)
        return cls(hashes[order], ids[order], ranks[order], int(np.diff(off).max()), byte_ids, model.unk_id(), data, off)

    def rank(self, spans: Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranks of spans; _NONE where no edge spans them."""
        out = np.full(len(start), _NONE)
        some = np.flatnonzero(end - start <= self.widest)
        at = is_member(spans.hash(start[some], end[some]), self.hashes)
        out[some] = np.where(at >= 0, self.ranks[np.maximum(at, 0)], _NONE)
        return out


def _fold_long(pieces: Pieces, spans: Spans, start: list[int], end: int) -> list[tuple[int, int]]:
    """Joins of one long word: a heap of pairs by (rank, place)."""
    n = len(start)
    ends = [*start[1:], end]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    first = pieces.rank(spans, np.array(start[:-1]), np.array(ends[1:])) if n > 1 else []
    heap = [(int(r), i, ends[i + 1]) for i, r in enumerate(first) if r < _NONE]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ends[j] != stop:
            continue
        ends[i], alive[j], after[i] = stop, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        pairs = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b >= 0]
        if pairs:
            ranks = pieces.rank(spans, np.array([start[a] for a, _ in pairs]), np.array([ends[b] for _, b in pairs]))
            for (a, b), r in zip(pairs, ranks):
                if r < _NONE:
                    heapq.heappush(heap, (int(r), a, ends[b]))
    return [(start[i], ends[i]) for i in range(n) if alive[i]]


def _fold(pieces: Pieces, spans: Spans, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins of many words at once: in each round, every word joins its best pair. Gives start, end and word of what is left."""
    done = []
    pair = np.full(len(start), _NONE)
    same = np.flatnonzero(word[1:] == word[:-1])
    pair[same] = pieces.rank(spans, start[same], end[same + 1])
    while len(start):
        bounds = group_bounds(word)
        place = np.arange(len(start))
        best = np.minimum.reduceat((pair << 32) | place, bounds[:-1])
        stuck = best >> 32 >= _NONE
        if stuck.any():
            over = np.repeat(stuck, np.diff(bounds))
            done.append((start[over], end[over], word[over]))
            keep = ~over
            new_place = np.cumsum(keep) - 1
            start, end, word, pair = start[keep], end[keep], word[keep], pair[keep]
            best = new_place[best[~stuck] & 0xFFFFFFFF]
            if not len(start):
                break
        else:
            best = best & 0xFFFFFFFF
        end[best] = end[best + 1]
        keep = np.ones(len(start), bool)
        keep[best + 1] = False
        at = best - np.arange(len(best))  # one symbol of each word before has gone
        start, end, word, pair = start[keep], end[keep], word[keep], pair[keep]
        for left in (at - 1, at):
            ok = (left >= 0) & (left + 1 < len(start))
            left = left[ok]
            inside = word[left] == word[left + 1]
            pair[left[~inside]] = _NONE
            left = left[inside]
            pair[left] = pieces.rank(spans, start[left], end[left + 1])
        if len(at) and at[-1] == len(start) - 1:
            pair[-1] = _NONE
    if not done:
        return start, end, word
    start, end, word = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], word[order]


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model sees them: the mark read as a space, one space before each text that isn't empty."""
    raw = data.tobytes()
    texts = [raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
    texts = [b" " + t.replace(_MARK, b" ") if t else b"" for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def encode_block(pieces: Pieces, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the n + 1 bounds of each text's."""
    data, off = _spaced(data, off)
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    space = data == 32
    begins = np.concatenate(([True], space[1:] & ~space[:-1]))
    begins[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    stop = np.append(at[1:], len(data))
    _, first, which = np.unique(Spans(data).hash(at, stop), return_index=True, return_inverse=True)
    # The distinct words, one after another.
    size = stop[first] - at[first]
    bounds = np.concatenate(([0], np.cumsum(size)))
    words = data[np.repeat(at[first] - bounds[:-1], size) + np.arange(bounds[-1])]
    spans = Spans(words)
    start = np.flatnonzero((words & 0xC0) != 0x80)
    end = np.append(start[1:], len(words))
    word = np.searchsorted(bounds, start, "right") - 1
    count = np.bincount(word, minlength=len(first))
    long_ = np.flatnonzero(count > LONG)
    short = count[word] <= LONG
    s, e, w = _fold(pieces, spans, start[short], end[short], word[short])
    if len(long_):
        lead = np.searchsorted(word, [long_, long_ + 1])
        extra = [(a, z, i) for i, x, y in zip(long_, *lead) for a, z in _fold_long(pieces, spans, start[x:y].tolist(), int(bounds[i + 1]))]
        more = np.array(extra, np.int64).T
        s, e, w = np.concatenate((s, more[0])), np.concatenate((e, more[1])), np.concatenate((w, more[2]))
        order = np.argsort(s, kind="stable")
        s, e, w = s[order], e[order], w[order]
    found = is_member(spans.hash(s, e), pieces.hashes)
    # A character without a piece becomes its bytes.
    width = np.where(found >= 0, 1, e - s)
    ids = np.repeat(np.where(found >= 0, pieces.ids[np.maximum(found, 0)], -1), width)
    places = np.repeat(s - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
    ids = np.where(ids >= 0, ids, pieces.byte_ids[words[np.minimum(places, len(words) - 1)]])
    per_word = np.concatenate(([0], np.cumsum(np.bincount(w, width, minlength=len(first)).astype(np.int64))))
    # Back to the texts.
    size = np.diff(per_word)[which]
    ends = np.concatenate(([0], np.cumsum(size)))
    out = ids[np.repeat(per_word[which] - ends[:-1], size) + np.arange(ends[-1])]
    return out, ends[np.searchsorted(at, off)]


def decode_block(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, without the space before each, and their n + 1 offsets."""
    size = pieces.text_off[ids + 1] - pieces.text_off[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = pieces.text[np.repeat(pieces.text_off[ids] - ends[:-1], size) + np.arange(ends[-1])]
    off = ends[bounds]
    lead = off[:-1][off[:-1] < off[1:]]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], off - np.searchsorted(lead, off)


def _broadcast(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(Pieces.load(model))  # some 32,000 pieces


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Adds `pieces` (array of ids) to docs, which has a column text. Null text counts as empty, which has no pieces. A column named pieces is replaced."""
    shared = _broadcast(docs.sparkSession, model)
    docs = docs.drop("pieces")

    def run(batches):
        for b in blocks(batches, size=BLOCK, docs=DOCS):
            ids, bounds = encode_block(shared.value, *utf8(b.column("text")))
            column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, "pieces"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """Adds `decoded` to rows, which has a column pieces; null has the empty text. Bytes that aren't UTF-8 become U+FFFD."""
    shared = _broadcast(rows.sparkSession, model)
    rows = rows.drop("decoded")

    def run(batches):
        for b in batches:
            lists = b.column("pieces").fill_null([]) if b.column("pieces").null_count else b.column("pieces")
            lists = pa.array(lists.to_pylist(), pa.list_(pa.int32())) if lists.offset else lists
            data, off = decode_block(shared.value, lists.values.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64))
            raw = data.tobytes()
            texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, round_trip (decoding gives the text again)."""
    shared = _broadcast(docs.sparkSession, model)

    def run(batches):
        for b in blocks(batches, size=BLOCK, docs=DOCS):
            data, off = utf8(b.column("text"))
            ids, bounds = encode_block(shared.value, data, off)
            back, back_off = decode_block(shared.value, ids, bounds)
            small, raw, was = ids.astype("<i4"), back.tobytes(), data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(small[a:z].tobytes()).hexdigest() for a, z in zip(bounds[:-1], bounds[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(back_off[:-1], back_off[1:])], pa.string()),
                    pa.array([raw[a:z] == was[c:d] for a, z, c, d in zip(back_off[:-1], back_off[1:], off[:-1], off[1:])], pa.bool_()),
                ],
                ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean")


def model_path(spark: SparkSession) -> str:
    """The model's file: the session's palim.tokenizer.model, or else the installed public one."""
    configured = spark.conf.get("palim.tokenizer.model", None)
    if configured:
        return configured
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, n_pieces, pieces_sha256, decoded_sha256, round_trip. Null text counts as empty, which has no pieces."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(spark))

"""Ranked lexical search by the threshold algorithm.

Documents are split between tasks. A task keeps the forward index of one block of documents at a time (each document's
query terms and counts) and, made from it, a list for each term in descending order of impact. For each item its lists are
read round robin, deeper in each round; a document seen for the first time gets its whole score by a look-up in the
forward index. The item is done with the block once the sum of what its lists can still give falls strictly below
its tenth best score, which a task carries from block to block. The best of all tasks are merged by Spark.

Statistics (documents, terms, how many documents hold a term) are those of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palim.llm.common import LOWER, Spans, blocks, discard, find_words, group_bounds, is_member, materialise, utf8

#: A term: what stands between ASCII characters that are neither digits nor letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = [not chr(i).isalnum() for i in range(128)]

TOP = 10
#: Pairs of an item and a term that are searched together: what is broadcast (some 30 bytes each).
PAIRS = 1_000_000
#: Documents, and pairs of a document and a term, of which a task holds lists at a time.
BLOCK_ROWS, BLOCK_PAIRS = 8192, 2_000_000
#: Postings of each list read in the first round; each round reads as many again as all before.
DEPTH = 32


def item_terms(items: DataFrame) -> DataFrame:
    """items: item, text. The distinct terms of each item."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item", F.explode(F.array_distinct(found)).alias("term"))


class Terms:
    """Terms as two hashes each, numbered by the first."""

    def __init__(self, terms: list[str]):
        data, off = utf8(pa.array(terms, pa.string()))
        first, second = Spans(data).hash(off[:-1], off[1:], 1, 2)
        order = np.argsort(first)
        self.first, self.second = first[order], second[order]
        self.number = {terms[i]: n for n, i in enumerate(order.tolist())}

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; the text and the number of each word that is one of the terms."""
        start, end, doc = find_words(data, off, _BREAKS)
        spans = Spans(LOWER[data])
        at = is_member(spans.hash(start, end, 1)[0], self.first)
        hit = np.flatnonzero(at >= 0)
        if len(hit):
            hit = hit[spans.hash(start[hit], end[hit], 2)[0] == self.second[at[hit]]]
        return np.bincount(doc, minlength=len(off) - 1), doc[hit], at[hit]


def forward_index(docs: DataFrame, terms) -> DataFrame:
    """doc_id, n (its terms with repeats), terms and tfs (those that are asked for, by number) of each document with a term. terms: a broadcast Terms."""

    def run(batches):
        for b in blocks(batches):
            n, doc, term = terms.value.find(*utf8(b.column("text")))
            size = len(terms.value.first) or 1
            pairs, tf = np.unique(doc * size + term, return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(b.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (pairs % size, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class _Best:
    """The TOP best of an item: by score, then the lesser id; a null id is the greatest."""

    def __init__(self):
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A sum of less can't get in."""
        return int(self.score[-1]) if len(self.score) == TOP else 0

    def add(self, score, doc, null) -> None:
        some = score >= max(1, self.floor())
        score, doc, null = (np.concatenate((a, b[some])) for a, b in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Block:
    """Forward index and impact-sorted lists of some documents."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, total: int):
        self.null = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
        self.doc = pc.fill_null(batch.column("doc_id"), 0).to_numpy().astype(np.int64)
        lists, tfs = batch.column("terms"), batch.column("tfs")
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.term = lists.flatten().to_numpy().astype(np.int64)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        m = 100 - 90 + (90 * batch.column("n").to_numpy().astype(np.int64) * documents) // total
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, self.size))
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = owner[order], self.impact[order]
        bounds = group_bounds(self.term[order])
        self.list_at = np.zeros(len(weights) + 1, np.int64)  # where each term's list begins
        self.list_at[self.term[order][bounds[:-1]] + 1] = np.diff(bounds)
        self.list_at = np.cumsum(self.list_at)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: _Best, own: np.ndarray) -> int:
        """Adds the block's documents to the best of an item. own: zeros, one for each term; zeros again afterwards. Returns the postings read."""
        at, end, weight = self.list_at[terms], self.list_at[terms + 1], weights[terms]
        some = (end > at) & (weight > 0)
        at, end, weight = at[some], end[some], weight[some]
        own[terms] = weights[terms]
        seen, step, read = np.zeros(len(self.size), bool), DEPTH, 0
        while len(at):
            full = len(best.score) == TOP
            if full and int((weight * self.list_impact[at]).sum()) < best.floor():
                break  # the threshold: nothing unseen can have more
            take = np.minimum(step, end - at)
            docs = self.list_doc[_ranges(at, take)]
            read += len(docs)
            docs = np.unique(docs[~seen[docs]])
            seen[docs] = True
            if len(docs):
                entries = _ranges(self.start[docs], self.size[docs])
                score = np.add.reduceat(own[self.term[entries]] * self.impact[entries], np.cumsum(self.size[docs]) - self.size[docs])
                best.add(score, self.doc[docs], self.null[docs])
            at = at + take
            left = at < end
            at, end, weight = at[left], end[left], weight[left]
            step *= 2
        own[terms] = 0
        return read


def _held(batches):
    """Batches of the forward index joined or cut to the size of a block."""
    held, rows, pairs = [], 0, 0
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)) if b.num_rows else []
        i = 0
        while i < b.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = min(int(np.searchsorted(ends, before + BLOCK_PAIRS - pairs, "right")), i + BLOCK_ROWS - rows)
            j = j if held else max(j, i + 1)
            if j > i:
                held.append(b.slice(i, j - i))
                rows, pairs = rows + j - i, pairs + int(ends[j - 1]) - before
            if j < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, pairs = [], 0, 0
            i = j
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searched(docs: DataFrame, pairs: list) -> DataFrame:
    """item, doc_id, score: the best of each task, for the given pairs of an item and a term."""
    spark = docs.sparkSession
    known = Terms(sorted({p["term"] for p in pairs}))
    terms = spark.sparkContext.broadcast(known)
    index = materialise(forward_index(docs, terms))
    stats = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    documents, total = stats["docs"], stats["total"] or 1
    df = np.zeros(len(known.first), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term that is asked for
        df[r["t"]] = r["count"]
    weights = np.array([int(x) for x in np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1)))], np.int64)
    item = np.array([p["item"] for p in pairs], np.int64)
    number = np.array([known.number[p["term"]] for p in pairs], np.int64)
    order = np.lexsort((number, item))
    bounds = group_bounds(item[order])
    asked = spark.sparkContext.broadcast((item[order][bounds[:-1]], number[order], bounds, weights))

    def run(batches):
        items, numbers, at, weights = asked.value
        best, own = [_Best() for _ in items], np.zeros(len(weights), np.int64)
        for b in _held(batches):
            block = Block(b, weights, documents, total)
            for i in range(len(items)):
                block.search(numbers[at[i] : at[i + 1]], weights, best[i], own)
        for i in range(0, len(items), 1024):
            part = best[i : i + 1024]
            doc, null, score = (np.concatenate([getattr(x, k) for x in part]) for k in ("doc", "null", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items[i : i + 1024], [len(x.score) for x in part])), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents with the highest scores above 0 for each item.

    docs: doc_id, text; each row is a document, also with a null or repeated id (a null id comes last among equal scores).
    Null and empty texts have no terms and don't count. items: item_id, text; equal rows count once, rows with one
    id and different texts are ranked each by its own text, items without a term or a match have no rows. Other columns don't matter.
    Items are searched in sets of PAIRS terms or so, so that what is broadcast stays bounded.
    """
    items = materialise(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    pairs = materialise(item_terms(items))
    n = pairs.count()
    sets = max(1, -(-n // PAIRS))
    found = None
    for i in range(sets):
        part = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(sets)) == i).collect()  # about PAIRS rows
        if part:
            rows = _searched(docs, part)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    discard(pairs)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return best.join(items, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_threshold_search(spark, sf_dir: str) -> DataFrame:
    """For each row of `benchmark` its 10 best `documents`: item_id, rank, doc_id, score."""
    return top_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

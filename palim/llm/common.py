"""Shared pieces: the shared work folder, and byte-level text arrays for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
BLOCK_BYTES = 1 << 20
#: Documents in one step, so that dense per-document arrays stay bounded.
BLOCK_DOCS = 1024

_M64 = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="palim-")
        sc.setCheckpointDir(top)
    # A folder without a scheme is on the default file system, for Spark's writers and for all others alike.
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath().rstrip('/')}/palim-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_the_query(spark: SparkSession):
    """Shuffle files of the queries run inside are dropped when each ends; Spark otherwise keeps them until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors cost nothing before it."""
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark)
    with shuffles_end_with_the_query(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._palim_path = path
    return out


#: Rows of a few numbers up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if its count allows it."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing will read again; other tables are left alone."""
    for t in tables:
        if path := getattr(t, "_palim_path", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int) -> Column:
    """Rows that no model learns from; a null id counts as held out."""
    return F.coalesce(id_crc() % modulus == remainder, F.lit(True))


def bounded_sample(rows: DataFrame, label: str, per_label: int, total: int, salt: int) -> DataFrame:
    """About per_label rows of each label, and about total at most, picked by a hash of the id.

    Labels beyond `total` in number aren't expected; only their counts come to the driver.
    """
    counts = [r for r in rows.groupBy(label).count().collect() if r[0] is not None]
    if not counts:
        return rows.limit(0)
    quota = min(per_label, max(1, total // len(counts)))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts:
        keep = keep | ((F.col(label) == F.lit(value)) & (share < F.lit(quota / n)))
    return rows.filter(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, remainder: int, per_label: int, total: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (doc_id, label 0 or 1) of docs that aren't held out, and a bounded sample of them with its texts.

    The sample is picked among ids alone and then broadcast (`total` rows or so), so that no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.filter("label IN (0, 1)").filter(~held_out(modulus, remainder)).distinct()
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = bounded_sample(known, "label", per_label, total, salt)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return known, texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES, docs: int = BLOCK_DOCS):
    """The rows of record batches in blocks of about `size` bytes in `column` and at most `docs` rows: larger batches are cut, smaller ones joined."""
    held, held_bytes = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        at = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(at), 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            rows = sum(b.num_rows for b in held)
            j = min(int(np.searchsorted(ends, before + size - held_bytes, "right")), i + docs - rows)
            if not held:
                j = max(i + 1, j)
            if j > i:
                held.append(batch.slice(i, j - i))
                held_bytes += int(ends[j - 1] - before)
            if j < batch.num_rows:
                yield joined()
                held, held_bytes = [], 0
            i = max(i, j)
    if held:
        yield joined()
    pa.default_memory_pool().release_unused()  # a worker that goes on to its next task gives back what this one needed


def block_bytes(shards: int) -> int:
    """Bytes of text that a block needs so that each of `shards` rows made from it holds some kilobytes; 16 MB at most."""
    return min(16 << 20, shards << 11)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes to bytes: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans above so many bytes are hashed one by one.
_LONG_SPAN = 256


class Spans:
    """Hashes of spans of bytes, the same wherever their content stands. Words of 8 bytes go through a finaliser one after another; no sum or product of the bytes stands for them."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.lanes = np.ndarray((len(data) + 1,), "<u8", self.data, 0, (1,))

    def hash(self, start: np.ndarray, end: np.ndarray, *seeds: int) -> np.ndarray | list[np.ndarray]:
        """64 bits of each span; with seeds, a list of as many independent hashes."""
        start = np.asarray(start, np.int64)
        left = np.asarray(end, np.int64) - start
        salts = [np.uint64(x * 0xD6E8FEB86659FD93 & _M64) for x in seeds or (0,)]
        out = [mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x) for x in salts]
        long_ = np.flatnonzero(left > _LONG_SPAN)
        active = np.flatnonzero(left <= _LONG_SPAN) if len(long_) else np.arange(len(start))
        at, left_ = start[active], left[active]
        some = np.flatnonzero(left_ > 0)
        active, at, left_ = active[some], at[some], left_[some]
        while len(active):
            lane = self.lanes[at] & _MASKS[np.minimum(left_, 8)]
            for h in out:
                h[active] = mix(h[active] ^ lane)
            more = np.flatnonzero(left_ > 8)
            active, at, left_ = active[more], at[more] + 8, left_[more] - 8
        for i in long_.tolist():
            part = memoryview(self.data)[int(start[i]) : int(start[i] + left[i])]
            for h, x in zip(out, salts):
                h[i] = xxhash.xxh3_64_intdigest(part, int(x))
        return out if seeds else out[0]


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of `length` of the given hashes, by its start: made of runs of 1, 2, 4, ... ."""
    n, out, at, size = len(values) - length + 1, None, 0, 1
    while size <= length:
        if length & size:
            part = values[at : at + n]
            out = part if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + part)
            at += size
        size *= 2
        if size <= length:
            values = mix(values[: len(values) - size // 2] * np.uint64(0xD1342543DE82EF95) + values[size // 2 :])
    return out


def find_words(data: np.ndarray, off: np.ndarray, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; documents end words."""
    solid = ~spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False, seeds: tuple = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes (one array for each seed) and document of each word. Arrays as wide as the text are made for some BLOCK_BYTES at a time."""
    hashes, docs, i, n = [], [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        part = data[off[i] : off[j]]
        start, end, doc = find_words(part, off[i : j + 1] - off[i])
        hashes.append(Spans(LOWER[part] if lower else part).hash(start, end, *seeds))
        docs.append(doc + i)
        i = j
    if not hashes:
        return [np.zeros(0, np.uint64) for _ in seeds], np.zeros(0, np.int64)
    return [np.concatenate(h) for h in zip(*hashes)], np.concatenate(docs)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds (empty ranges give 0)."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, behind their sizes in bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def unpack(payload, *kinds) -> list[np.ndarray]:
    """The arrays of pack(), by their kinds."""
    sizes = np.frombuffer(payload, np.uint32, len(kinds))
    out, at = [], 4 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def range_shard(route: np.ndarray, shards: int) -> np.ndarray:
    """A shard by the upper half of a 64-bit hash: ascending with it."""
    return ((route >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def group_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def is_member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """For each value its index among sorted distinct ones, or -1; a small table by low bits settles most."""
    out = np.full(len(values), -1, np.int64)
    if len(sorted_) and len(values):
        table = np.zeros(1 << 20, bool)
        table[(sorted_ & np.uint64(0xFFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(table[(values & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(sorted_, values[some]), len(sorted_) - 1)
        right = sorted_[at] == values[some]
        out[some[right]] = at[right]
    return out

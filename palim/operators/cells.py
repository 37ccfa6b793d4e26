"""Products of two sets of vectors with one key, cell by cell.

A key's rows on either side are dealt out in parts of a bounded size; a cell is one part of each side. So no key
fills a task, a cell is one matrix product, and only the best of each probe leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.shipping import ship

#: Rows of a key in one part, on the side of the probes and on that of the members.
PROBES, MEMBERS = 512, 4096
#: How far below the last kept score a score may lie and still leave its cell: more than rounding to 9 digits can hide.
SLACK = 2e-9


#: Large keys up to which they are broadcast; beyond, rows meet them in a join that may split its keys at run time.
BROADCAST_KEYS = 200_000


def _parts(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Keys with more than `size` rows, and their parts."""
    found = rows.groupBy(F.col(key).alias(f"__{name}_key")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > size).select(f"__{name}_key", F.ceil(F.col("__n") / size).cast("int").alias(f"__{name}_parts"))
    few = found.limit(BROADCAST_KEYS + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(few, found.schema)) if len(few) <= BROADCAST_KEYS else found


def _part(of: Column, parts: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(of), F.col(parts)), F.lit(0)).cast("int")


def _all(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))


def nearest(probes: DataFrame, members: DataFrame, key: str, limit: int, threshold: float | None = None) -> DataFrame:
    """probe, member, score: inner products of probes (key, probe, vector, and exclude: a member left out, or null) and members (key, member, vector) of one key.

    Of each probe and cell the `limit` best scores above the threshold, and those that tie with the last: a superset of the
    probe's `limit` best. Vectors of different length, empty or null ones score 0. A null key meets nothing.
    """
    ship(probes.sparkSession)
    large_probes, large_members = _parts(probes, key, PROBES, "p"), _parts(members, key, MEMBERS, "m")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col(key).isNotNull())
        return rows.join(large_probes, F.col(key) == F.col("__p_key"), "left").join(large_members, F.col(key) == F.col("__m_key"), "left")

    id_type = members.schema["member"].dataType
    left = dealt(probes).select(key, _part(F.col("probe"), "__p_parts").alias("__p"), _all("__m_parts").alias("__m"), F.lit(0).alias("__side"), "probe", F.col("exclude").cast(id_type).alias("member"), "vector")
    right = dealt(members).select(key, _all("__p_parts").alias("__p"), _part(F.col("member"), "__m_parts").alias("__m"), F.lit(1).alias("__side"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), "member", "vector")
    cells = left.unionByName(right.select(*left.columns))
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, key, "__p", "__m").sortWithinPartitions(key, "__p", "__m", "__side")

    def run(batches):
        for cell in _groups(batches, [key, "__p", "__m"]):
            yield from _best(cell, limit, threshold)

    types = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    return cells.mapInArrow(run, f"probe {types['probe']}, member {types['member']}, score double")


def _groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the keys; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for i, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and their values one after another."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)


def _best(cell: pa.Table, limit: int, threshold: float | None) -> Iterator[pa.RecordBatch]:
    side = cell.column("__side").to_numpy()
    n_probes = int((side == 0).sum())
    if limit <= 0 or not n_probes or n_probes == len(side):
        return
    probes, members = cell.slice(0, n_probes), cell.slice(n_probes)
    (p_size, p_data), (m_size, m_data) = _matrix(probes.column("vector")), _matrix(members.column("vector"))
    scores = np.zeros((n_probes, len(m_size)))
    for d in np.intersect1d(p_size, m_size):
        if d:
            p, m = p_size == d, m_size == d
            scores[np.ix_(p, m)] = p_data[np.repeat(p, p_size)].reshape(-1, d) @ m_data[np.repeat(m, m_size)].reshape(-1, d).T
    excluded = pc.index_in(probes.column("member").combine_chunks(), members.column("member").combine_chunks(), skip_nulls=True)
    out = pc.fill_null(excluded, -1).to_numpy(zero_copy_only=False)
    scores[np.flatnonzero(out >= 0), out[out >= 0]] = -np.inf
    least = np.full(n_probes, -np.inf)
    if scores.shape[1] > limit:
        least = np.partition(scores, -limit, axis=1)[:, -limit] - SLACK
    keep = (scores >= least[:, None]) & (scores > (-np.inf if threshold is None else threshold))
    i, j = np.nonzero(keep)
    if len(i):
        yield pa.RecordBatch.from_arrays([probes.column("probe").combine_chunks().take(pa.array(i)), members.column("member").combine_chunks().take(pa.array(j)), pa.array(scores[i, j])], ["probe", "member", "score"])

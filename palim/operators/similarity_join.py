"""Exact join of vectors whose inner product is above a threshold, most pairs of which are never multiplied out.

Between cells: the vectors of a large key go to the nearest of some pivots. Two groups whose pivots lie so far
apart that no angle between their members can be small enough (the triangle inequality on angles) never meet.

Within a cell: vectors are turned so that their first coordinates hold most of their length. The product of two prefixes and of the
norms of what is left bounds a pair's product; a pair goes on to its next coordinates only while the bound is above the
threshold. What is left at the end is multiplied as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.operators import cells
from palim.operators.cells import _groups, _matrix
from palim.shipping import ship
from palim.sources.store import stored

#: Pivots of a table, and vectors from which its axes are found: samples by a hash of the id.
PIVOTS, AXES_SAMPLE = 64, 4096
#: Rows of a key on the side of the members from which on pivots split it.
LARGE = 1 << 14
#: What rounding may hide in a bound.
SLACK = 1e-9
#: Shares of the coordinates at which a pair's bound is looked at.
STAGES = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8)
#: Share of a cell's pairs below which they go on one by one; above, rows and columns that still have pairs go on as a matrix.
FEW = 1 / 16


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes, those of the most length first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.zeros((0, 0))


def pairs_above(probes: np.ndarray, members: np.ndarray, threshold: float, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pairs (i, j) whose product may be above the threshold, in no order: all that are, and few others; multiplications made for them; pairs whose every coordinate was used."""
    d = probes.shape[1]
    p, m = (probes @ turn, members @ turn) if turn is not None and turn.shape[0] == d else (probes, members)
    cuts = sorted({max(1, round(d * s)) for s in STAGES if d * s >= 1} | {d})
    rows, columns = np.arange(len(p)), np.arange(len(m))
    rest_p, rest_m = (np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])) for x in (p, m))
    rest_p, rest_m = (np.concatenate((r, np.zeros((len(r), 1))), axis=1) for r in (rest_p, rest_m))
    made, a, finished = 0, 0, len(p) * len(m)
    so_far, i, j = np.zeros((len(p), len(m))), None, None
    for z in cuts:
        if i is None:
            so_far += p[rows, a:z] @ m[columns, a:z].T
            made += so_far.size * (z - a)
            alive = so_far + rest_p[rows, z][:, None] * rest_m[columns, z][None, :] > threshold - SLACK
            if z < d and alive.size and alive.mean() > FEW:
                keep_r, keep_c = alive.any(1), alive.any(0)
                if not (keep_r.all() and keep_c.all()):
                    rows, columns, so_far = rows[keep_r], columns[keep_c], so_far[np.ix_(keep_r, keep_c)]
            else:
                finished = so_far.size
                x, y = np.nonzero(alive)
                i, j, so_far = rows[x], columns[y], so_far[x, y]
        else:
            so_far = so_far + np.einsum("ij,ij->i", p[i, a:z], m[j, a:z])
            made += len(i) * (z - a)
            alive = so_far + rest_p[i, z] * rest_m[j, z] > threshold - SLACK
            finished = len(i)
            i, j, so_far = i[alive], j[alive], so_far[alive]
        if i is not None and not len(i):
            return i, j, made, 0
        a = z
    return i, j, made, finished


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each the farthest by angle from those before it."""
    if not len(sample):
        return sample
    unit = _unit(sample)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return sample[chosen]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """About n vectors of the most frequent length, by a hash of the member."""
    found = [r[0] for r in rows.filter(F.size("vector") > 0).select("vector", F.xxhash64("member", F.lit(17)).alias("h")).orderBy("h").limit(n).collect()]
    if not found:
        return np.zeros((0, 0))
    sizes, counts = np.unique([len(v) for v in found], return_counts=True)
    return np.array([v for v in found if len(v) == sizes[counts.argmax()]], float)


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (with large: whether the key is) with pivot, angle to it and norm; vectors that pivots don't fit go to a group of their own, -1, which meets all."""
    shared = rows.sparkSession.sparkContext.broadcast(_unit(pivots) if len(pivots) else pivots)  # PIVOTS vectors at most
    names = rows.columns

    def run(batches):
        for b in batches:
            size, data = _matrix(pa.chunked_array([b.column("vector")]))
            large = b.column("large").to_numpy(zero_copy_only=False)
            known = shared.value
            pivot, angle, norm = np.where(large, -1, 0), np.full(len(size), np.pi), np.full(len(size), np.inf)
            fits = large & (size == (known.shape[1] if len(known) else -1))
            if fits.any():
                own = data[np.repeat(fits, size)].reshape(-1, known.shape[1])
                cosine = _unit(own) @ known.T
                pivot[fits], angle[fits], norm[fits] = cosine.argmax(1), _angle(cosine.max(1)), np.linalg.norm(own, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(angle), pa.array(norm)], [*names, "pivot", "angle", "norm"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, pivot int, angle double, norm double")


def _stats(placed: DataFrame, key: str, size: int, side: str) -> DataFrame:
    return placed.groupBy(F.col(key).alias("__key"), F.col("pivot").alias(side)).agg(
        F.max("angle").alias(f"{side}_angle"), F.max("norm").alias(f"{side}_norm"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{side}_parts")
    )


def meeting(probe_stats: DataFrame, member_stats: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """__key, a, b, a_parts, b_parts: groups of one key that may have a pair above the threshold."""
    spark = probe_stats.sparkSession
    between = _angle(_unit(pivots) @ _unit(pivots).T) if len(pivots) else np.zeros((0, 0))
    table = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(between)) for j in range(len(between))], "a int, b int, between double")  # PIVOTS squared
    both = probe_stats.join(member_stats, "__key").join(F.broadcast(table), ["a", "b"], "left")
    least = F.greatest(F.lit(0.0), F.col("between") - F.col("a_angle") - F.col("b_angle") - SLACK)
    reach = F.cos(F.least(least, F.lit(float(np.pi))))
    bound = F.when(reach > 0, reach * F.col("a_norm") * F.col("b_norm")).otherwise(0.0)
    open_ = F.col("between").isNull() | (F.col("a_angle") >= np.pi) | (F.col("b_angle") >= np.pi)
    return both.filter(open_ | (bound > threshold - SLACK)).select("__key", "a", "b", "a_parts", "b_parts")


def _in_cells(probes: DataFrame, members: DataFrame, key: str, threshold: float):
    """Both sides dealt out to cells (rows of the probes first), the columns that name a cell, and the axes, broadcast."""
    spark = probes.sparkSession
    ship(spark)
    size = members.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LARGE).select("__k")
    sample = _sample(members, AXES_SAMPLE)
    turn = spark.sparkContext.broadcast(axes(sample))  # as many rows and columns as a vector has coordinates
    pivots = spread(sample, PIVOTS)

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col(key).isNotNull() & (F.size("vector") > 0))
        return _placed(rows.join(size, F.col(key) == F.col("__k"), "left").withColumn("large", F.col("__k").isNotNull()).drop("__k"), pivots)

    id_type = members.schema["member"].dataType
    left = placed(probes.select(key, "probe", F.col("exclude").cast(id_type).alias("member"), "vector"))
    right = placed(members.select(key, F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), "member", "vector"))
    pairs = stored(meeting(_stats(left, key, cells.PROBES, "a"), _stats(right, key, cells.MEMBERS, "b"), pivots, threshold))

    def dealt(rows: DataFrame, own: str, other: str, of: str, side: int) -> DataFrame:
        met = rows.join(pairs, (F.col(key) == F.col("__key")) & (F.col("pivot") == F.col(own)))
        part = F.pmod(F.xxhash64(of), F.col(f"{own}_parts")).cast("int")
        return met.select(key, "a", "b", part.alias(f"{own}_part"), F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part"), F.lit(side).alias("__side"), "probe", "member", "vector")

    columns = [key, "a", "b", "a_part", "b_part", "__side", "probe", "member", "vector"]
    both = dealt(left, "a", "b", "probe", 0).select(*columns).unionByName(dealt(right, "b", "a", "member", 1).select(*columns))
    cell = [key, "a", "b", "a_part", "b_part"]
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell, "__side"), cell, turn


def above(probes: DataFrame, members: DataFrame, key: str, limit: int, threshold: float, work=None) -> DataFrame:
    """probe, member, score: as cells.nearest(), for a threshold of 0 or more. work: an accumulator of multiplications, or None.

    Of each probe and cell the `limit` best scores above the threshold, and those that tie with the last. Vectors of different length, empty or null ones
    score 0 and so are never above. A null key meets nothing.
    """
    if threshold < 0:
        return cells.nearest(probes, members, key, limit, threshold)
    both, cell, turn = _in_cells(probes, members, key, threshold)

    def run(batches):
        for table in _groups(batches, cell):
            yield from _best(table, limit, threshold, turn.value, work)

    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    return both.mapInArrow(run, f"probe {types['probe']}, member {types['member']}, score double")


def linked(probes: DataFrame, members: DataFrame, key: str, threshold: float) -> DataFrame:
    """a, b: members that connect as all pairs of a probe and a member above the threshold do. Each probe is a member, too, by its id (exclude). A cell gives a row for each of its rows at most, however many pairs it has."""
    both, cell, turn = _in_cells(probes, members, key, threshold)
    kind = members.schema["member"].dataType.simpleString()

    def run(batches):
        for table in _groups(batches, cell):
            n = int((table.column("__side").to_numpy() == 0).sum())
            if n and n < table.num_rows:
                i, j = _pairs(table, n, threshold, turn.value)[:2]
                root = _roots(table.num_rows, i, n + j)
                other = np.flatnonzero(root != np.arange(len(root)))
                names = table.column("member").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(root[other])), names.take(pa.array(other))], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least element connected to each of n, over the links a[i], b[i]."""
    root = np.arange(n)
    while len(a):
        # Whole groups move: what hangs on a root goes with it, so that a link once closed stays so.
        of_a, of_b = root[a], root[b]
        least = np.minimum(of_a, of_b)
        np.minimum.at(root, of_a, least)
        np.minimum.at(root, of_b, least)
        while not np.array_equal(again := root[root], root):
            root = again
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _pairs(cell: pa.Table, n: int, threshold: float, turn: np.ndarray, work=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probe (of the first n rows), member (counted from row n) and product of all pairs of a cell that may be above the threshold."""
    (p_size, p_data), (m_size, m_data) = _matrix(cell.slice(0, n).column("vector")), _matrix(cell.slice(n).column("vector"))
    found_i, found_j, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for d in np.intersect1d(p_size, m_size):
        at_p, at_m = np.flatnonzero(p_size == d), np.flatnonzero(m_size == d)
        p, m = p_data[np.repeat(p_size == d, p_size)].reshape(-1, d), m_data[np.repeat(m_size == d, m_size)].reshape(-1, d)
        i, j, made, _ = pairs_above(p, m, threshold, turn)
        if work is not None:
            work.add(made)
        found_i.append(at_p[i])
        found_j.append(at_m[j])
        scores.append(np.einsum("ij,ij->i", p[i], m[j]))
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(scores)


def _best(cell: pa.Table, limit: int, threshold: float, turn: np.ndarray, work) -> Iterator[pa.RecordBatch]:
    n = int((cell.column("__side").to_numpy() == 0).sum())
    if limit <= 0 or not n or n == cell.num_rows:
        return
    probes, members = cell.slice(0, n), cell.slice(n)
    i, j, score = _pairs(cell, n, threshold, turn, work)
    excluded = pc.fill_null(pc.index_in(probes.column("member").combine_chunks(), members.column("member").combine_chunks(), skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    keep = (score > threshold) & (excluded[i] != j)
    i, j, score = i[keep], j[keep], score[keep]
    # Of each probe the best, and what rounding may not tell from the last of them.
    order = np.lexsort((-score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    last = np.minimum(first + limit, np.searchsorted(i, i, "right")) - 1
    keep = score >= score[last] - cells.SLACK
    i, j, score = i[keep], j[keep], score[keep]
    if len(i):
        yield pa.RecordBatch.from_arrays([probes.column("probe").combine_chunks().take(pa.array(i)), members.column("member").combine_chunks().take(pa.array(j)), pa.array(score)], ["probe", "member", "score"])

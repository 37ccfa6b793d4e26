"""Sharding by a k-d tree: weighted medians along the widest dimension, found by distributed histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim.llm.common import materialise, small

#: Ranges of a dimension counted at once while a median is searched.
BINS = 1024
#: Rows of a part of a shard; parts are numbered independently, so that no task holds a whole shard.
SLOT_ROWS = 1_000_000


@dataclass
class _Node:
    shard: int  # first shard of the node
    shards: int  # leaves below it
    low: list
    high: list


def _leaf(nodes: list[tuple[_Node, list]], node: Column, dims: list[str]) -> Column:
    """The node after a split: (node, cut) for each split one; a cut is (dimension, value) of a heavy value for each dimension but the last, which has the last value of its left side."""
    out = node
    for parent, cut in nodes:
        right = F.lit(False)
        for i, (dim, value) in enumerate(reversed(cut)):
            beyond = F.col(dims[dim]) > F.lit(value)
            right = beyond if i == 0 else beyond | ((F.col(dims[dim]) == F.lit(value)) & right)
        half = parent.shard + parent.shards // 2
        out = F.when(node == parent.shard, F.when(right, F.lit(half)).otherwise(F.lit(parent.shard))).otherwise(out)
    return out


@dataclass
class _Search:
    """The search for a node's cut."""

    node: _Node
    total: float
    due: float  # weight due to the left side, of the rows that agree with the prefix
    dim: int
    whole: list  # dimensions still to try on the whole node
    rest: list  # dimensions to cut a heavy value along
    prefix: list  # (dimension, heavy value)
    first: tuple | None = None  # heavy value of the widest dimension, and the weight below it


def kd_shards(rows: DataFrame, dims: list[str], weight: str, shards: int, tie: str, tolerance: float = 0.02) -> DataFrame:
    """Adds `shard` (0 to shards - 1) with near equal sums of weight.

    rows: a small-row table (metadata only) with integer, non-null dims; it is read once for each
    histogram round, so hand over a stored table. Rows that agree in all dims are a group and stay
    together, unless the group alone would unbalance a split by more than `tolerance` of its node; then
    it is split along `tie` (an integer column), where the exact median falls. Where the median of the widest dimension
    misses by more, the others are tried; if all do, only the rows of its heavy value are cut along them, the tie column at last.

    Each round counts BINS ranges for each node: at most shards * BINS sums reach the driver. A median
    among 2**32 values takes four rounds. Empty input gives no rows; equal rows, a split along `tie`.
    """
    axes = [*dims, tie]
    nodes = [_Node(0, shards, [], [])]
    split: list[tuple[Column, list]] = []
    placed = rows.withColumn("__node", F.lit(0))
    while any(n.shards > 1 for n in nodes):
        stats = {
            r["__node"]: r
            for r in placed.groupBy("__node")
            .agg(F.sum(weight).alias("w"), *[f(a).alias(f"{x}{i}") for i, a in enumerate(axes) for x, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        }
        if len(nodes) == 1 and 0 in stats:
            spread = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(len(axes))]
        open_, cuts = [], []
        for n in nodes:
            if n.shards > 1 and n.shard in stats:
                s = stats[n.shard]
                n.low, n.high = [s[f"lo{i}"] for i in range(len(axes))], [s[f"hi{i}"] for i in range(len(axes))]
                width = [(n.high[i] - n.low[i]) / spread[i] for i in range(len(dims))]
                order = sorted((i for i in range(len(dims)) if width[i] > 0), key=lambda i: -width[i])
                dim, *others = [*order, len(dims)]
                total = float(s["w"])
                open_.append(_Search(n, total, total * (n.shards // 2) / n.shards, dim, others[:-1], others, []))
        while open_:
            again = []
            for x, (cut, error, value, below) in zip(open_, _medians(placed, axes, weight, open_)):
                if error <= tolerance * x.total or x.dim == len(dims):
                    cuts.append((x.node, [*x.prefix, (x.dim, cut)]))
                    continue
                if not x.prefix:
                    x.first = x.first or (x.dim, value, below)
                    if x.whole:
                        x.dim, *x.whole = x.whole
                        again.append(x)
                        continue
                    x.dim, value, below = x.first
                x.prefix.append((x.dim, value))
                x.due -= below
                x.dim, *x.rest = x.rest
                again.append(x)
            open_ = again
        placed = placed.withColumn("__node", _leaf(cuts, F.col("__node"), axes))
        following = []
        for n in nodes:
            if n.shards == 1 or n.shard not in stats:
                following.append(_Node(n.shard, 1, [], []))
            else:
                half = n.shards // 2
                following += [_Node(n.shard, half, [], []), _Node(n.shard + half, n.shards - half, [], [])]
        nodes = following
    return placed.withColumnRenamed("__node", "shard")


def _medians(placed: DataFrame, axes: list[str], weight: str, wanted: list[_Search]) -> list[tuple]:
    """For each search: the last value of the left side, how far its weight is from the share due, the value where that falls and the weight below it."""
    ranges = [[x.node.low[x.dim], x.node.high[x.dim], 0.0] for x in wanted]  # low, high, weight below low
    due = [x.due for x in wanted]
    best: list = [None] * len(wanted)
    while pending := [i for i in range(len(wanted)) if best[i] is None]:
        conditions = []
        for i in pending:
            n, d, (low, high, _) = wanted[i].node, wanted[i].dim, ranges[i]
            step = -(-(high - low + 1) // BINS)
            here = (F.col("__node") == n.shard) & F.col(axes[d]).between(low, high)
            for heavy, value in wanted[i].prefix:
                here &= F.col(axes[heavy]) == F.lit(value)
            conditions.append((here, i, F.floor((F.col(axes[d]) - F.lit(low)) / F.lit(step)).cast("int"), step))
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for here, i, b, _ in conditions:
            which, bin_ = F.when(here, F.lit(i)).otherwise(which), F.when(here, b).otherwise(bin_)
        counted: dict = {}
        for r in placed.select(which.alias("i"), bin_.alias("b"), F.col(weight).alias("w")).filter("i IS NOT NULL").groupBy("i", "b").agg(F.sum("w").alias("w")).collect():
            counted.setdefault(r["i"], []).append((r["b"], float(r["w"])))
        for _, i, _, step in conditions:
            low, high, below = ranges[i]
            for b, w in sorted(counted.get(i, [])):
                if below + w >= due[i]:
                    if step == 1:
                        value = low + b
                        before, after = abs(below - due[i]), abs(below + w - due[i])
                        best[i] = (value - 1, before, value, below) if before < after else (value, after, value, below)
                    else:
                        ranges[i] = [low + b * step, min(high, low + (b + 1) * step - 1), below]
                    break
                below += w
            else:
                best[i] = (high, abs(below - due[i]), high, below)
    return best


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; law `bytes`: shards hold near equal bytes.

    The dimensions are metadata that equal texts share, so that these share a leaf unless they outweigh it: bytes, code
    points, lines, and the checksum. Null text counts as empty; a null doc_id sorts as 0 where a group must be split;
    repeated rows each get a slot.
    """
    meta = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
            (F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) + 1).cast("long").alias("n_lines"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("__tie"),
        )
    )
    placed = kd_shards(meta, ["size", "n_chars", "n_lines", "text_crc32"], "size", shards, "__tie")
    return number_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def number_slots(placed: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard: parts of a shard, as many as its rows call for, are numbered apart, then moved by the counts before them."""
    n = max(1, -(-placed.count() // SLOT_ROWS))
    parts = placed.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(max(n, 8))).cast("int"))
    counts = parts.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each SLOT_ROWS rows and shard
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = parts.withColumn("__row", F.row_number().over(Window.partitionBy("shard", "__part").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(small(materialise(offsets)), ["shard", "__part"]).withColumn("slot", (F.col("__before") + F.col("__row") - 1).cast("long"))


def op9_kd_sharding(spark, sf_dir: str) -> DataFrame:
    """All of `documents` in shards 0 to 7: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null). Null text has size 1 and checksum 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

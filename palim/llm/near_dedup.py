"""SimHash near-duplicates: fingerprints, links found by BK-trees, and connected components.

Two fingerprints that differ in at most RADIUS bits agree in at least p - RADIUS of p parts, so that equal
values of some two parts (RADIUS 4, p 6) bring every linked pair together. p grows with the number of fingerprints, so that
chance groups stay within a tree. Distinct fingerprints are dealt out by those values; each group is a BK-tree. Of a group too large for a tree, all members first ask the tree of a part of it, the
hub; what is then not yet in one component with most of the group is asked by all in a second pass. So a dense cluster costs
rows in proportion to its members, and no pair is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.llm.bk_tree import Forest
from palim.llm.common import blocks, discard, materialise, mix, small, utf8

RADIUS = 4
#: Pairs that are confirmed at once.
CONFIRM = 4096
#: Fingerprints in a tree; larger groups are split.
TREE = 1024
#: Texts of a group in one part, where all parts meet.
TEXTS = 2048
#: Parts to choose from, most at last: more of them make longer keys and more copies of each fingerprint.
MOST_PARTS = 8
#: Classes with over 1 / HOT of all rows (fewer than HOT) are broadcast to their members instead of gathering them.
HOT = 10_000


def shingle_hashes(text: bytes, words: int) -> tuple[bytes, np.ndarray]:
    """The words (A-Z lowered) joined by single spaces, and XXH64 (seed 42) of each shingle, repeats included; fewer words than a shingle has: one of all."""
    tokens = text.lower().split()  # bytes: ASCII letters and spaces only
    line = b" ".join(tokens)
    if not tokens:
        return line, np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return line, np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    return line, np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes; none: 0."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for a in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int) -> int:
    return majority(shingle_hashes(text, words)[1])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, print (64 bits as long) of each whole text: A-Z lowered, shingles of `words` words (fewer: all of them). Null text counts as empty."""

    def run(batches):
        for b in blocks(batches):
            data, off = utf8(b.column("text"))
            raw = data.tobytes()
            got = [fingerprint(raw[a:z], words) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long")


def parts_for(n: int, radius: int) -> int:
    """The least number of parts (two more than the radius at least) whose keys give n fingerprints groups of half a tree on average."""
    parts = radius + 2
    while parts < max(MOST_PARTS, radius + 2) and n >> (64 * (parts - radius) // parts) > TREE // 2:
        parts += 1
    return parts


def _masks(radius: int, parts: int) -> list[int]:
    """The bits of each choice of parts that a linked pair must agree in."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    part = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(parts)]
    return [sum(part[i] for i in c) for c in combinations(range(parts), parts - radius)]


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least element of each element's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(again := root[root], root):
            root = again


def _group_parts(keyed: DataFrame, tree: int) -> DataFrame:
    """choice, key, parts (of `tree` members) of each group with several members."""
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return materialise(sizes.select("choice", "key", F.ceil(F.col("n") / tree).cast("int").alias("parts")))


def _part_of(member: str, parts: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(member, F.lit(seed)), F.col(parts)).cast("int")


def _first_pass(keyed: DataFrame, groups: DataFrame, member: str) -> DataFrame:
    """A group of one part is a block. Of a larger one, part p asks in the block (0, p), whose tree is the hub, part 0."""
    grouped = keyed.join(groups, ["choice", "key"]).withColumn("p", _part_of(member, "parts", 9))
    blocks_ = F.when(F.col("p") > 0, F.array("p")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = grouped.withColumn("y", F.explode(blocks_))
    return placed.select("choice", "key", F.lit(0).alias("x"), "y", member, (F.col("p") == 0).alias("tree"), (F.col("p") == F.col("y")).alias("asks"))


def _second_pass(keyed: DataFrame, groups: DataFrame, member: str, rooted: DataFrame) -> DataFrame:
    """Larger groups again: members outside the component that holds most of their group are trees, in parts x, which every part y of the group asks."""
    large = keyed.join(groups.filter("parts > 1"), ["choice", "key"])
    labelled = materialise(large.join(rooted.withColumnRenamed("node", member), member, "left").select("choice", "key", "parts", member, F.coalesce("root", member).alias("label")))
    counts = labelled.groupBy("choice", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = materialise(counts.groupBy("choice", "key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select("choice", "key", F.col("m.label").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / TREE).cast("int").alias("trees")).filter("trees > 0"))
    rows = labelled.join(most, ["choice", "key"])
    trees = rows.filter("label <> main").select("choice", "key", _part_of(member, "trees", 13).alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), member, F.lit(True).alias("tree"), F.lit(False).alias("asks"))
    asks = rows.select("choice", "key", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("x"), _part_of(member, "parts", 9).alias("y"), member, F.lit(False).alias("tree"), F.lit(True).alias("asks"))
    return trees.unionByName(asks)


def _all_parts(keyed: DataFrame, groups: DataFrame, member: str) -> DataFrame:
    """One pass for groups whose members need not be near each other (they share a shingle, a line that many texts have): part p is the tree of the blocks (p, y)
    for y >= p and asks in the blocks (x, p) for x <= p, so that each two parts meet once."""
    grouped = keyed.join(groups, ["choice", "key"]).withColumn("p", _part_of(member, "parts", 9)).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return grouped.select("choice", "key", F.least("p", "o").alias("x"), F.greatest("p", "o").alias("y"), member, (F.col("p") <= F.col("o")).alias("tree"), (F.col("p") >= F.col("o")).alias("asks"))


def _in_blocks(placed: DataFrame, member: str) -> DataFrame:
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "choice", "key", "x", "y").sortWithinPartitions("choice", "key", "x", "y", member)


def _all_links(keyed: DataFrame, member: str, search) -> DataFrame:
    """Links (a, b) that connect all linked members; search(placed) finds those of the blocks of a pass. keyed: choice, key, member."""
    groups = _group_parts(keyed, TREE)
    edges = materialise(search(_first_pass(keyed, groups, member)))
    if not groups.filter("parts > 1").limit(1).count():
        return edges
    more = search(_second_pass(keyed, groups, member, components(edges)))
    return edges.unionByName(more)


def _whole_blocks(batches, rows: int):
    """Tables of some `rows` rows that end where a block ends."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        tail = pa.concat_tables([tail, table]) if tail is not None and tail.num_rows else table
        if tail.num_rows >= rows:
            ids = _block_ids(tail)
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield tail.slice(0, cut)
                tail = tail.slice(cut)
    if tail is not None and tail.num_rows:
        yield tail


def links(prints: DataFrame, radius: int = RADIUS, parts: int = RADIUS + 2) -> DataFrame:
    """print: distinct fingerprints (long). Rows (a, b), a < b: enough links within the radius to connect all that are linked.

    One row at most for each fingerprint, choice of parts and block.
    """
    masks = _masks(radius, parts)
    keyed = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks])).alias("choice", "key"))

    def run(batches):
        for t in _whole_blocks(batches, 1 << 16):
            prints_ = t.column("print").to_numpy()
            yield _pairs(prints_, _search(t, radius), ("a", "b"))

    return _all_links(keyed, "print", lambda placed: _in_blocks(placed, "print").mapInArrow(run, "a long, b long"))


def _block_ids(t: pa.Table) -> np.ndarray:
    cols = [t.column(c).to_numpy() for c in ("choice", "key", "x", "y")]
    new = np.zeros(t.num_rows, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _pairs(names: np.ndarray, root: np.ndarray, out: tuple[str, str]) -> pa.RecordBatch:
    """Distinct pairs of each element's name and its root's."""
    other = np.flatnonzero(root != np.arange(len(root)))
    x, y = names[other], names[root[other]]
    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], list(out))


def _search(t: pa.Table, radius: int, confirm=None, short: np.ndarray | None = None) -> np.ndarray:
    """The root of each row in its block's components; confirm(a, b): which pairs of rows are links beyond their distance. short: rows that ask about their whole block."""
    ids = _block_ids(t)
    prints = t.column("print").to_numpy().view(np.uint64)
    tree, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "asks"))
    in_tree, asking = np.flatnonzero(tree), np.flatnonzero(asks)
    known, group = np.unique(ids[in_tree], return_inverse=True)
    forest = Forest(prints[in_tree], group)
    root = np.arange(t.num_rows)
    asked = [(asking, radius)] if short is None else [(asking[~short[asking]], radius), (asking[short[asking]], 64)]
    for a, b in ((some[q], in_tree[node]) for some, r in asked if len(some) for q, node in forest.within(prints[some], np.searchsorted(known, ids[some]), r)):
        step = len(a) if confirm is None else CONFIRM
        for i in range(0, len(a), step):  # what is joined by now needs no further look
            x, y = a[i : i + step], b[i : i + step]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            if confirm is not None and len(x):
                real = confirm(x, y)
                x, y = x[real], y[real]
            if len(x):
                root = _merge(root, x, y)
    return root


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after elements a[i] and b[i] are joined."""
    top = _local_roots(len(root), root[a], root[b])
    return top[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes in edges (a, b).

    Alternating large and small stars: every round, nodes link to the least neighbour, until nothing changes.
    Each round writes a table of at most the edges before it; minima are summed map-side, so a
    node of any degree costs a row for each task.
    """
    current = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours go to the least one.
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Small star: smaller neighbours, and the node, go to the least one.
        least = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(least, F.col("b") == F.col("n"))
        moved = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b"))
        following = materialise(moved.filter("a <> b").distinct())
        discard(current)
        current = following
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            rooted = materialise(current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
            discard(current)
            return rooted
        state = now


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, print, component_id: the least doc_id reachable over links of at most `radius` differing bits.

    Null text counts as empty, whose fingerprint is 0 and links like any other. Rows with a null doc_id keep their
    fingerprint and are in a component, but never name it; without another id it is null. Repeated rows stay.
    """
    printed = materialise(fingerprints(docs, words))
    classes = materialise(printed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    rooted = components(links(classes.select("print"), radius, parts_for(classes.count(), radius)))
    names = rooted.join(classes, rooted["node"] == classes["print"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("node").alias("print"), "component_id")
    classes = materialise(classes.join(named, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"), "copies"))
    return _to_members(printed, classes, "print").select("doc_id", "print", "component_id")


def _to_members(members: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """members joined to classes (key, component_id, copies), both stored tables. Members of large classes stay where they are."""
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    large = F.col("copies") > max(1, total // HOT)
    hot = classes.filter(large).select(F.col(key).alias("__key"), F.col("component_id").alias("__hot"))
    marked = members.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
    rest = marked.filter("__key IS NULL").select(*members.columns).join(classes.filter(~large).select(key, "component_id"), key).select(*members.columns, "component_id")
    return rest.unionByName(marked.filter("__key IS NOT NULL").select(*members.columns, F.col("__hot").alias("component_id")))


#: For groups by similarity: smallest shingles that deal a text out (a pair of similarity s shares none with a chance of (1 - s) ** KEYS),
#: shingle hashes in a sketch (32 bits each), the radius of the search (of random hashes a pair of similarity 0.8 differs in over 28 bits with a chance of 10^-8), and
#: how far below the similarity a sketch's estimate is a clear miss (five standard errors).
KEYS, SKETCH, WIDE, SLACK = 5, 128, 28, 0.18
#: Texts of so few shingles, whose fingerprints may lie farther apart, are compared with all of their blocks. Two texts of so few
#: are dealt out by the PREFIX smallest shingles of one order besides, of which a pair of similarity 0.8 or more always shares one: none is missed.
SHORT, PREFIX = 31, 7
_NONE = -1
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest (of the words), print (of the distinct shingles), keys and sketch of each whole text."""

    def run(batches):
        for b in blocks(batches):
            data, off = utf8(b.column("text"))
            raw = data.tobytes()
            digests, prints, keys, sketches = [], [], [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                line, hashes = shingle_hashes(raw[a:z], words)
                hashes = np.unique(hashes)  # similarity is on sets, and so is the fingerprint
                digests.append(xxhash.xxh3_128_digest(line))
                prints.append(majority(hashes))
                if len(hashes):
                    orders = mix(hashes[None, :] ^ _SEEDS[:, None])
                    prefix = np.full(PREFIX, _NONE)
                    if len(hashes) <= SHORT:
                        least = np.sort(orders[0])[: len(hashes) // 5 + 1].view(np.int64)  # of n, n - ceil(0.8 n) + 1
                        prefix[: len(least)] = least
                    keys.append([*orders.min(1).view(np.int64).tolist(), *prefix.tolist()])
                else:
                    keys.append([])
                sketches.append(np.unique((mix(hashes) >> np.uint64(32)).astype(np.uint32))[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "digest", "print", "keys", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, digest binary, print long, keys array<long>, sketch binary")


def _similar(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sketches of rows a[i] and b[i] share at least `least` of the SKETCH smallest of both (of all, if there are fewer)."""
    both = np.sort(np.concatenate((sketches[a], sketches[b]), axis=1), axis=1)  # filled up with the largest value
    double = both[:, 1:] == both[:, :-1]
    valid = both < _FILL
    first = valid.copy()
    first[:, 1:] &= ~double
    rank = np.cumsum(first, axis=1)
    inside = valid & (rank <= SKETCH)
    total = (first & inside).sum(1)
    shared = (double & inside[:, 1:]).sum(1)
    return shared >= least * total - 1e-9


_FILL = np.uint64(1 << 32)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """least, digest and shingles (all distinct hashes, ascending) of the texts with the ids in wanted (least). Repeated rows stay."""

    def run(batches):
        for b in blocks(batches):
            data, off = utf8(b.column("text"))
            raw = data.tobytes()
            digests, sets = [], []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                line, hashes = shingle_hashes(raw[a:z], words)
                digests.append(xxhash.xxh3_128_digest(line))
                sets.append(np.unique(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("least"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["least", "digest", "shingles"])

    wanted = small(materialise(wanted))
    own = docs.select(F.col("doc_id").cast("long").alias("least"), "text").join(wanted, "least", "left_semi")
    return own.mapInArrow(run, "least long, digest binary, shingles binary")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(len(x) + len(y) - shared, 1)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash (which tells rows with one id apart), component_id: the least doc_id of each document's group, texts being linked if their shingle sets are similar (Jaccard).

    Texts of equal words are one text first. Each goes to the trees of its smallest shingles under KEYS orders (and short ones to those of a prefix of one order); pairs within WIDE
    bits there, and all pairs of texts of SHORT shingles or fewer, are compared by their sketches, and what is no clear miss, by their whole sets of shingles. Texts without words are all equal. Rows with a null doc_id are left out;
    rows with one id are judged each by its own text.
    """
    profiles = materialise(_profiles(docs.filter("doc_id IS NOT NULL"), words))
    texts = materialise(profiles.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("print", "keys", "sketch")]))
    keyed = texts.select("least", F.posexplode("keys").alias("choice", "key")).filter((F.col("choice") < KEYS) | (F.col("key") != _NONE)).withColumn("choice", F.least("choice", F.lit(KEYS)))

    place = ["choice", "key", "x", "y", "least", "tree", "asks", "print", "digest", "keys"]

    def meets_first(t: pa.Table):
        """Which pairs of rows share no key before that of their block: two texts with several common keys are compared once."""
        keys = np.concatenate([c.flatten().to_numpy() for c in t.column("keys").chunks]).reshape(-1, KEYS + PREFIX)
        choice, key = t.column("choice").to_numpy(), t.column("key").to_numpy()

        def first(a, b):
            same = keys[a, :KEYS] == keys[b, :KEYS]
            out = np.where(same.any(1), same.argmax(1) == choice[a], False)
            rest = np.flatnonzero(~same.any(1) & (choice[a] == KEYS))
            if len(rest):
                x, y = keys[a[rest], KEYS:], keys[b[rest], KEYS:]
                common = (x[:, :, None] == y[:, None, :]).any(2) & (x != _NONE)
                out[rest] = x[np.arange(len(rest)), common.argmax(1)] == key[a[rest]]
            return out

        return first

    def screen(batches):
        """Rows with a neighbour in their block that isn't a clear miss."""
        for t in _whole_blocks(batches, 1 << 13):
            lists = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("sketch").combine_chunks()]
            size = np.array([len(x) for x in lists])
            sketches = np.full((len(lists), SKETCH), _FILL, np.uint64)
            sketches[np.arange(SKETCH) < size[:, None]] = np.concatenate(lists)
            first = meets_first(t)

            def close(a, b):
                out = first(a, b)
                out[out] = _similar(sketches, a[out], b[out], similarity - SLACK)
                return out

            root = _search(t, WIDE, close, size <= SHORT)
            yield from t.select(place).filter(pa.array(np.bincount(root, minlength=len(root))[root] > 1)).combine_chunks().to_batches()

    def verify(batches):
        for t in _whole_blocks(batches, 1 << 11):
            sets = [np.frombuffer(x, np.uint64) for chunk in t.column("shingles").chunks for x in chunk.to_pylist()]
            first = meets_first(t)

            def exact(a, b):
                out = first(a, b)
                out[out] = [_jaccard(sets[i], sets[j]) >= similarity - 1e-9 for i, j in zip(a[out].tolist(), b[out].tolist())]
                return out

            yield _pairs(t.column("least").to_numpy(), _search(t, WIDE, exact, np.array([len(x) for x in sets]) <= SHORT), ("a", "b"))

    schema = "choice int, key long, x int, y int, least long, tree boolean, asks boolean, print long, digest binary, keys array<long>"
    profile = texts.select("least", "print", "sketch", "digest", "keys")

    def search(placed: DataFrame) -> DataFrame:
        near = materialise(_in_blocks(placed.join(profile, "least"), "least").mapInArrow(screen, schema))
        sets = _shingle_sets(docs, near.select("least").distinct(), words)
        return _in_blocks(small(near).join(sets, ["least", "digest"]), "least").mapInArrow(verify, "a long, b long")

    rooted = components(materialise(search(_all_parts(keyed, _group_parts(keyed, TEXTS), "least"))))
    named = texts.select("digest", "least", "copies").join(rooted, F.col("least") == F.col("node"), "left").select("digest", F.coalesce("root", "least").alias("component_id"), "copies")
    return _to_members(profiles.select("doc_id", "text_hash", "digest"), materialise(named), "digest").select("doc_id", "text_hash", "component_id")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op10_simhash_bk_tree(spark, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, fingerprint (hex), component_id. Null and empty texts have fingerprint zero and are linked like others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hexadecimal("print").alias("fingerprint"), "component_id")

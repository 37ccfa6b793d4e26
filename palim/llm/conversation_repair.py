"""Repair of conversations by signatures.

Each row of a conversation is one character: its role's initial and its fault. The characters of BLOCK rows in order are a
signature; a conversation has one signature, or several in a row if it is long. Each distinct signature is solved once,
by a recursion over its halves that remembers what it has solved: the cheapest edits from each state of the grammar to
each other. Solutions are joined back to the conversations that have the signature; those of a long conversation are
put together WIDE at a time. The edits are then replayed over the rows.

Grammar: `(s?(ua)+)?` over the initials of system, user and assistant. Edits: Keep 0, Rerole to user or assistant 3, Delete 4
(required for blank rows and duplicates), Insert an empty user or assistant row 3; a truncated row that isn't deleted adds 3.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.llm.common import discard, materialise

#: Rows of a signature; parts of a conversation that are put together at once.
BLOCK, WIDE = 256, 64
#: Distinct signatures that a task remembers.
REMEMBERED = 1 << 16

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACES = " \t\n\x0b\f\r"
#: A row's character: 4 times its class (system, user, assistant, any other) and its fault.
_CLASSES = "sua"
_NONE, _BLANK, _DUPLICATE, _CUT = range(4)
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_AFTER = {"u": _USER, "a": _ASSISTANT, "s": _SYSTEM}
_LEGAL = {"su", "ua", "au"}


def _next_role(state: int) -> str:
    """The role that an inserted or a reroled row has in this state."""
    return "assistant" if state == _USER else "user"


# A solution is a 4 x 4 list of (cost, edits) or None, from state to state. Equal costs go to the least string: of two edit
# strings over the same rows one is never the beginning of the other at the same cost, so that parts can be joined.


def _inserts() -> list:
    out = [[None] * 4 for _ in _STATES]
    for a in _STATES:
        out[a][a], state = (0, ""), a
        for n in (1, 2):
            state = _AFTER[_next_role(state)[0]]
            out[a][state] = min((n * INSERT, "I" * n), out[a][state] or (n * INSERT, "I" * n))
    return out


def _then(x: list, y: list) -> list:
    return [[min(((p[0] + q[0], p[1] + q[1]) for p, q in ((x[a][m], y[m][b]) for m in _STATES) if p and q), default=None) for b in _STATES] for a in _STATES]


def _edits(character: str) -> list:
    """The edits of one row."""
    kind, fault = divmod(int(character, 16), 4)
    initial = (_CLASSES + "?")[kind]
    out = [[None] * 4 for _ in _STATES]
    for a in _STATES:
        out[a][a] = (DELETE, "D")
        if fault in (_NONE, _CUT):
            more = TRUNCATED * (fault == _CUT)
            role = _next_role(a)[0]
            out[a][_AFTER[role]] = (KEEP + more, "K") if role == initial else (REROLE + more, "R")
    if initial == "s" and fault in (_NONE, _CUT):
        out[_START][_SYSTEM] = (KEEP + TRUNCATED * (fault == _CUT), "K")
    return out


_INSERTS = _inserts()


@functools.lru_cache(REMEMBERED)
def solve(signature: str) -> list:
    """The cheapest edits of a signature from state to state, inserts before each row included."""
    if len(signature) == 1:
        return _then(_INSERTS, _edits(signature))
    half = len(signature) // 2
    return _then(solve(signature[:half]), solve(signature[half:]))


def cheapest(solution: list) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    ends = _then(solution, _INSERTS)[_START]
    return min(x for x in (ends[_START], ends[_ASSISTANT]) if x)


def _illegal(classes: str) -> int:
    return sum(classes[i : i + 2] not in _LEGAL for i in range(len(classes) - 1))


_PART = "blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<long>, edits array<string>"
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _part(signature: str) -> tuple:
    codes = [int(c, 16) for c in signature]
    classes = "".join((_CLASSES + "?")[c // 4] for c in codes)
    faults = [sum(c % 4 == f for c in codes) for f in (_BLANK, _DUPLICATE, _CUT)]
    flat = [x for row in solve(signature) for x in row]
    return (*faults, _illegal(classes), classes[0], classes[-1], [x and x[0] for x in flat], [x and x[1] for x in flat])


def _joined(parts: list[dict]) -> tuple:
    """Parts that follow one another as one."""
    whole, counts, tail = None, [0, 0, 0, 0], None
    for p in parts:
        flat = [None if c is None else (c, e) for c, e in zip(p["costs"], p["edits"])]
        own = [flat[4 * a : 4 * a + 4] for a in _STATES]
        whole = own if whole is None else _then(whole, own)
        counts = [x + p[k] for x, k in zip(counts, _PART_NAMES[:4])]
        counts[3] += tail is not None and tail + p["head"] not in _LEGAL
        tail = p["tail"]
    flat = [x for row in whole for x in row]
    return (*counts, parts[0]["head"], tail, [x and x[0] for x in flat], [x and x[1] for x in flat])


def _record(rows: list[tuple], schema: str, first: dict) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    columns = [pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(schema.split(", "))]
    return pa.RecordBatch.from_arrays([*first.values(), *columns], [*first, *names])


def _solved(batches):
    for b in batches:
        yield _record([_part(s) for s in b.column("signature").to_pylist()], _PART, {"signature": b.column("signature")})


def _put_together(batches):
    for b in batches:
        yield _record([_joined(parts) for parts in b.column("parts").to_pylist()], _PART, {"conv_id": b.column("conv_id"), "part": b.column("part")})


def _answers(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            flat = [None if c is None else (c, e) for c, e in zip(r["costs"], r["edits"])]
            rows.append((*(r[k] for k in _PART_NAMES[:4]), *cheapest([flat[4 * a : 4 * a + 4] for a in _STATES])))
        yield _record(rows, _ANSWER, {"conv_id": b.column("conv_id")})


_ANSWER = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def in_order(rows: DataFrame) -> DataFrame:
    """The rows stored in the order of conversations and turns (nulls first, equal turns by role and text), with their place.

    Rows are dealt out by conversation and turn, so that a conversation of any length lies in as many parts as it needs.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn("__at", F.monotonically_increasing_id()))
    # Numbers without gaps: a count for each part, of which there are as many as shuffle partitions.
    counts = sorted((r[0], r[1]) for r in stored.groupBy(F.shiftright("__at", 33)).count().collect())
    before, starts = 0, []
    for part, count in counts:
        starts.append((part, before - (part << 33)))
        before += count
    moved = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __move long"))
    out = stored.join(moved, F.shiftright("__at", 33) == F.col("__part")).select("conv_id", "turn", "role", "text", (F.col("__at") + F.col("__move")).alias("at"))
    out._palim_path = stored._palim_path
    return out


def _meet(left: DataFrame, right: DataFrame, how: str, *names: str) -> DataFrame:
    """A join on columns of the same names, in which null meets null."""
    right = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__right_{n}"))
    return left.join(right, on, how).drop(*[f"__right_{n}" for n in names])


def signatures(ordered: DataFrame) -> DataFrame:
    """conv_id, part (a number that ascends in each conversation) and signature."""
    text = F.rtrim("text", F.lit(_SPACES))
    kind = F.instr(F.lit(_CLASSES), F.substring("role", 1, 1))
    kind = F.when((kind > 0) & (F.col("role") != ""), kind - 1).otherwise(3)
    rows = ordered.select("conv_id", "role", "at", F.md5(F.col("text").cast("binary")).alias("digest"), kind.alias("kind"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    repeated = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    fault = F.when(F.col("blank"), _BLANK).when(F.col("at") > F.col("first"), _DUPLICATE).when(F.col("cut"), _CUT).otherwise(_NONE)
    marked = _meet(rows, repeated, "left", "conv_id", "role", "digest").select("conv_id", "at", F.lower(F.hex(4 * F.col("kind") + fault)).alias("c"))
    blocks = marked.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("rows"))  # BLOCK rows at most
    return blocks.select("conv_id", "part", F.array_join(F.col("rows")["c"], "").alias("signature"))


def audits(ordered: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation of in_order()."""
    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    parts = materialise(signatures(ordered))
    solved = parts.groupBy("signature").count().select("signature").mapInArrow(_solved, f"signature string, {_PART}")
    # A signature that very many conversations have is a hot key of this join; its right side has one row, so Spark may split the left at run time.
    known = materialise(parts.join(solved, "signature").drop("signature"))
    discard(parts)
    span = known.groupBy("conv_id").agg(F.min("part").alias("from"), F.max("part").alias("to"))
    longest = span.agg(F.max(F.col("to") - F.col("from"))).first()[0] or 0
    if longest:
        several = span.filter("to > from")
        long_ = _meet(known, several, "inner", "conv_id").withColumn("part", F.col("part") - F.col("from")).drop("from", "to")
        short = span.filter("to = from")
        single = _meet(known, short, "left_semi", "conv_id")
        while longest:
            grouped = long_.groupBy("conv_id", F.floor(F.col("part") / WIDE).alias("up")).agg(F.array_sort(F.collect_list(F.struct("part", *_PART_NAMES))).alias("parts"))  # WIDE at most
            long_ = grouped.select("conv_id", F.col("up").alias("part"), "parts").mapInArrow(_put_together, f"conv_id {types['conv_id']}, part long, {_PART}")
            longest //= WIDE
        known = single.select("conv_id", *_PART_NAMES).unionByName(long_.select("conv_id", *_PART_NAMES))
    return known.select("conv_id", *_PART_NAMES).mapInArrow(_answers, f"conv_id {types['conv_id']}, {_ANSWER}")


def _replay(batches):
    """conv_id, role and text of each row that is left or inserted, in order. A conversation's edits come before its rows."""
    edits, at, state = "", 0, _START

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            role = _next_role(state)
            state, at = _AFTER[role[0]], at + 1
            yield role, ""

    conv = None
    for b in batches:
        for conv_id, audit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                for x in inserted():  # behind the last row of the conversation before
                    yield conv, *x
                conv, edits, at, state = conv_id, audit, 0, _START
                continue
            for x in inserted():
                yield conv, *x
            edit, at = edits[at], at + 1
            if edit != "D":
                role = _next_role(state) if edit == "R" else role
                state = _AFTER[role[0]]
                yield conv, role, text
    for x in inserted():
        yield conv, *x


def _with_edits(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits and, behind them, its rows in order. A hash or a replay is one chain, so a conversation is one task's here; it streams through and isn't held."""
    rows = ordered.select("conv_id", "at", F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(heads).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at")


#: Rows of the repaired table that are written at once.
_ROWS = 4096


def repaired(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the conversations of in_order() with the edits of audits() made. A conversation of which nothing is left has no row."""
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def record(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "place", "role", "text"])

        held, last, place, id_type = [], None, 0, None

        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        for conv, role, text in _replay(typed()):
            place = place + 1 if last == (conv,) else 0
            last = (conv,)
            held.append((conv, place, role, text))
            if len(held) == _ROWS:
                yield record(held)
                held = []
        if held:
            yield record(held)

    return _with_edits(ordered, found).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def digests(ordered: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired rows as `role:text`, joined by newlines, for conversations that have any left."""
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches):
        ids, hashes, hashed, last, id_type = [], [], None, None, None

        def typed():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def record():
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

        for conv, role, text in _replay(typed()):
            if last != (conv,):
                if last:
                    ids.append(last[0])
                    hashes.append(hashed.hexdigest())
                    if len(ids) == _ROWS:
                        yield record()
                        ids, hashes = [], []
                last, hashed = (conv,), hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode())
        if last:
            ids.append(last[0])
            hashes.append(hashed.hexdigest())
            yield record()

    return _with_edits(ordered, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by crc32(`conv_id:turn`) % 20: 0 is dropped, 1 has an empty text, 2 no `.!?`, 3 comes twice, 4 is the user's. Nulls are written as one space; conv_id and turn stay null."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", blank))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).when(fault == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation id of ids (conv_id), null included: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text; other columns don't matter. Null roles and texts stand as one space. Equal turns are ordered by role and a hash of the text,
    a null turn comes first. A role with another initial, or none, can only be reroled or deleted. Ids without rows: zeros, an empty audit and the hash of the empty text.
    """
    ordered = in_order(rows)
    found = materialise(audits(ordered))
    turns = ordered.filter("turn IS NOT NULL").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = ids.select("conv_id").distinct()
    for more in (found, turns, digests(ordered, found)):
        out = _meet(out, more, "left", "conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All of `conversations`, damaged by the fixed rule: what is wrong with each, its cheapest edits and the hash of what they make of it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damaged(rows), rows)

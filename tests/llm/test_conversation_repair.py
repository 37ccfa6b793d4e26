import hashlib
import heapq
import itertools
import random
import re

import pytest

from palim.llm import conversation_repair as cr
from palim.llm.conversation_repair import audits, cheapest, damaged, digests, in_order, repaired, report, solve

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\f\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(SPACES)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by uniform-cost search over (rows taken, roles given), least string first; the grammar is asked by its pattern."""
    faults = faults_of(rows)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, edits, roles
        key = (i, roles[-1:], roles[:1] == "s")
        if key in done:
            continue
        done.add(key)
        follow = [r for r in "sua" if re.fullmatch(r"s?(ua)*u?", roles + r)]
        for r in follow:
            if r != "s":
                heapq.heappush(heap, (cost + 3, edits + "I", i, roles + r))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, roles))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                for r in follow:
                    if rows[i][0][:1] == r:
                        heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + r))
                    elif r != "s":
                        heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, roles + r))


def replayed(rows, edits, roles):
    out, i, k = [], 0, 0
    names = {"s": "system", "u": "user", "a": "assistant"}
    for e in edits:
        if e == "I":
            out.append((names[roles[k]], ""))
        elif e == "K":
            out.append(rows[i])
        elif e == "R":
            out.append((names[roles[k]], rows[i][1]))
        i, k = i + (e != "I"), k + (e != "D")
    return out


def want(rows, turns):
    faults = faults_of(rows)
    cost, edits, roles = brute(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    known = [t for t in turns if t is not None]
    body = "\n".join(f"{r}:{t}" for r, t in replayed(rows, edits, roles))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256(body.encode()).hexdigest())


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", "What?", " ", "", f"t{rng.randint(0, 30)}.", f"t{rng.randint(0, 30)}"])) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 20])
def test_solutions_equal_a_search(size):
    rng = random.Random(size)
    for _ in range(150):
        rows = random_rows(rng, size)
        codes = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        signature = "".join(f"{4 * {'s': 0, 'u': 1, 'a': 2}.get(r[:1], 3) + codes[f]:x}" for (r, _), f in zip(rows, faults_of(rows)))
        assert cheapest(solve(signature)) == brute(rows)[:2], (rows, signature)


def _conversations(spark, talks):
    rows = [(c, t, r, x, 9) for c, rows in talks.items() for t, (r, x) in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").repartition(5)


@pytest.mark.parametrize("block,wide", [(256, 64), (4, 2)])
def test_report_equals_brute_force(spark, monkeypatch, block, wide):
    """Also with conversations of many signatures, put together in several rounds."""
    monkeypatch.setattr(cr, "BLOCK", block)
    monkeypatch.setattr(cr, "WIDE", wide)
    rng = random.Random(block)
    talks = {c: list(enumerate(random_rows(rng, rng.randint(1, 9)))) for c in range(25)}
    talks[None] = [(None, ("user", "hello")), (3, ("assistant", "a.")), (7, ("user", "b."))]
    talks[99] = list(enumerate(random_rows(rng, 60)))
    talks[100] = [(None, ("system", "x."))]
    rows = _conversations(spark, talks)
    ids = rows.select("conv_id").union(spark.createDataFrame([(777,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in report(rows, ids).collect()}
    for c, talk in talks.items():
        assert got.pop(c) == want([x for _, x in talk], [t for t, _ in talk]), c
    assert got == {777: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repaired_rows(spark):
    talks = {1: list(enumerate([("user", "Hi."), ("user", "again."), ("system", "late."), ("assistant", "ok.")])), 2: [(0, ("system", "alone."))]}
    ordered = in_order(_conversations(spark, talks))
    found = audits(ordered)
    rows = sorted(tuple(r) for r in repaired(ordered, found).collect())
    for c, talk in talks.items():
        own = [x for _, x in talk]
        cost, edits, roles = brute(own)
        assert [(r, t) for i, _, r, t in rows if i == c] == replayed(own, edits, roles)
    assert [p for i, p, _, _ in rows if i == 1] == list(range(sum(i == 1 for i, *_ in rows)))
    assert digests(ordered, found).count() == len({i for i, *_ in rows})


def test_damage(spark):
    import zlib

    rows = spark.createDataFrame([(c, t, None if c == 3 else "system", None if t == 2 else "A. b! c?") for c in (1, 2, 3, None) for t in (0, 1, 2, 3, 4, 5, 6, None)], "conv_id long, turn long, role string, text string")
    out = []
    for c, t, r, x in map(tuple, rows.collect()):
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        out += [(c, t, "user" if fault == 4 else r, x)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(str, (tuple(r) for r in damaged(rows).collect()))) == sorted(map(str, out))


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(none, none).count() == 0
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    assert {tuple(r)[:8] for r in report(none, ids).collect()} == {(c, 0, 0, 0, 0, 0, 0, "") for c in (5, None)}

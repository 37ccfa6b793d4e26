import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palim.operators import segmentation as seg
from palim.operators.ordered import dense_seq, running_sum, with_previous
from palim.streaming import segments as live

START = datetime(2026, 1, 1)


def stream(spark, gaps, conversation="c", chars=20):
    """Messages with these gaps (timedelta) between neighbours."""
    at, rows = START, [(conversation, 0, "user", "x" * chars, START)]
    for i, g in enumerate(gaps):
        at += g
        rows.append((conversation, i + 1, "user", "x" * chars, at))
    return spark.createDataFrame(rows, "conversation_id string, seq long, role string, content string, ts timestamp")


def minutes(m, s=0):
    return timedelta(minutes=m, seconds=s)


def test_gap_edges(spark):
    gaps = [minutes(29, 59), minutes(30), minutes(30, 59), minutes(180), minutes(180, 1), minutes(-5)]
    rows = seg.adjacent_gaps(stream(spark, gaps)).orderBy("seq").collect()
    assert [(r["boundary"], r["gap_minutes"]) for r in rows[1:]] == [("none", 29), ("soft", 30), ("soft", 30), ("soft", 180), ("hard", 180), ("none", -5)]


def test_legacy_gap_is_strict(spark):
    assert seg.legacy_time_gap(stream(spark, [minutes(30), minutes(30, 1)])).count() == 2


@pytest.mark.parametrize(("n", "classes"), [(4, ["informative"]), (1, ["low_info"]), (5, ["informative"]), (20, ["informative"]), (21, ["informative", "informative"])])
def test_bucket_sizes(spark, n, classes):
    rows = seg.primitive_review(stream(spark, [minutes(1)] * (n - 1))).orderBy("start_seq").collect()
    assert [r["classification"] for r in rows] == classes


def test_split_indices(spark):
    df = spark.createDataFrame([(6, [0, 3, 3, 9, 1])], "n long, s array<int>")
    got = df.select(seg.split_ranges(F.col("n"), F.col("s"))).first()[0]
    assert [(r["first"], r["last"]) for r in got] == [(0, 0), (1, 2), (3, 5)]


@pytest.mark.parametrize(("n", "starts", "sizes"), [(5, [0, 2], [2, 3]), (5, [3], [3, 2]), (4, [99, 2], [2, 2]), (4, [2, 0, 2], [2, 2])])
def test_legacy_plan(spark, n, starts, sizes):
    items = [(s, "high") for s in starts]
    df = spark.createDataFrame([(n, items)], "n long, i array<struct<start:int,surprise:string>>")
    got = df.select(seg.resolve_plan(F.col("n"), F.col("i"))).first()[0]
    assert [r["last"] - r["first"] + 1 for r in got] == sizes
    assert got[0]["surprise"] == ("high" if 0 in starts else "low")


def segments(spark, sizes, origins=None, kinds=None):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append(("c", at, at + n - 1, n, (kinds or ["informative"] * len(sizes))[i], (origins or [None] + ["rule_soft"] * (len(sizes) - 1))[i], None))
        at += n
    return spark.createDataFrame(rows, "conversation_id string, start_seq long, end_seq long, n long, classification string, origin string, gap_minutes long")


@pytest.mark.parametrize(
    ("sizes", "origins", "kinds", "groups"),
    [
        ([14, 15, 10], None, None, [0, 0, 0]),
        ([15, 15, 10], None, None, [0, 0, 30]),
        ([5, 5], [None, "rule_hard"], None, [0, 5]),
        ([5, 5], [None, "llm_locked"], None, [0, 5]),
        ([5, 3, 5], None, ["informative", "low_info", "informative"], [0, 5, 8]),
    ],
)
def test_merge_groups(spark, sizes, origins, kinds, groups):
    rows = seg.merge_groups(segments(spark, sizes, origins, kinds)).orderBy("start_seq").collect()
    assert [r["group_start"] for r in rows] == groups


def test_commit_plan(spark):
    one, three = segments(spark, [5]), segments(spark, [5, 5, 5])
    assert [(r["finalized"], r["next_seq"]) for r in seg.commit_plan(one).collect()] == [(False, 0)]
    assert sorted((r["start_seq"], r["finalized"], r["next_seq"]) for r in seg.commit_plan(three).collect()) == [(0, True, 10), (5, True, 10), (10, False, 10)]
    assert {(r["finalized"], r["next_seq"]) for r in seg.commit_plan(three, eof=True).collect()} == {(True, 15)}


def test_claim_trigger(spark):
    cases = {"a19": (19, 1, False, None), "b20": (20, 1, False, None), "c2gap": (2, 30, False, None), "d1eof": (1, 1, True, None), "e_active": (25, 1, False, 0)}
    messages, states = None, []
    for name, (n, gap, eof, active) in cases.items():
        part = stream(spark, [minutes(gap)] * (n - 1), name)
        messages = part if messages is None else messages.unionByName(part)
        states.append((name, n - 1, eof, 0, active, None if active is None else n - 1, None if active is None else START))
    state = spark.createDataFrame(states, "conversation_id string, last_message_seq long, eof_identified boolean, next_segment_start_seq long, active_segment_start_seq long, active_segment_end_seq long, active_since timestamp")
    got = {r["conversation_id"]: r["due"] for r in seg.claim_trigger(state, messages).collect()}
    assert got == {"a19": False, "b20": True, "c2gap": True, "d1eof": True, "e_active": False}


def test_lease_boundary(spark):
    now = datetime(2026, 1, 2)
    rows = [(f"m{m}s{s}", 9, False, 5, 3, 9, now - timedelta(minutes=m, seconds=s)) for m, s in ((119, 59), (120, 0), (120, 1))]
    state = spark.createDataFrame(rows, "conversation_id string, last_message_seq long, eof_identified boolean, next_segment_start_seq long, active_segment_start_seq long, active_segment_end_seq long, active_since timestamp")
    got = seg.stale_leases(state, F.lit(now)).collect()
    assert [(r["conversation_id"], r["next_segment_start_seq"]) for r in got] == [("m120s1", 3)]


def test_frame_equals_fold(spark):
    rng = random.Random(4)
    rows, wanted = [], []
    for c in range(6):
        at, log = 0, []
        for i in range(rng.randint(1, 120)):
            at += rng.choice([1, 1, 1, 1, 1, 29, 30, 31, 180, 181, -5]) * live.MINUTE
            log.append((i, at, rng.randint(1, 30)))
        rows += [(f"c{c}", s, "user", "y" * k, START + timedelta(microseconds=u)) for s, u, k in log]
        wanted += [(f"c{c}", x["start"], x["end"], x["kind"]) for x in live.merged(live.primitive(log))]
    messages = spark.createDataFrame(rows, "conversation_id string, seq long, role string, content string, ts timestamp")
    got = [tuple(r) for r in seg.merge_sweep(seg.primitive_review(messages)).select("conversation_id", "start_seq", "end_seq", "classification").collect()]
    assert sorted(got) == sorted(wanted)


def test_spans_leave_when_nothing_can_change_them():
    log = [(i, i * live.MINUTE + (live.MINUTE * 60 if i >= 10 else 0), 20) for i in range(15)]
    assert live.advance(log, False) == ([], log, False)  # the segment behind the soft gap may still join the one before
    hard = [(i, i * live.MINUTE + (live.MINUTE * 600 if i >= 10 else 0), 20) for i in range(15)]
    done, rest, inside = live.advance(hard, False)
    assert [(d["start"], d["end"]) for d in done] == [(0, 9)] and not inside
    done, rest, inside = live.advance(rest, True)
    assert [(d["start"], d["end"]) for d in done] == [(10, 14)]
    assert rest == []


def test_spans_do_not_depend_on_the_batches():
    rng = random.Random(9)
    for _ in range(300):
        at, log = 0, []
        for i in range(rng.randint(1, 150)):
            at += rng.choice([1] * rng.randint(2, 30) + [29, 30, 31, 180, 181, -5]) * live.MINUTE
            log.append((i, at, rng.randint(1, 30)))
        done, held, inside, most = [], [], False, 0
        for a in range(0, len(log), step := rng.choice([1, 2, 7, 40, 200])):
            spans, held, inside = live.advance(held + log[a : a + step], a + step >= len(log), inside)
            done += spans
            most = max(most, len(held))
        want = [(x["start"], x["end"], x["kind"]) for x in live.merged(live.primitive(log))]
        assert [(x["start"], x["end"], x["kind"]) for x in done] == want
        assert held == [] and most <= 80


def test_ordered_primitives_across_ranges(spark):
    rows = spark.range(50).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") * 3).alias("o"), F.col("id").alias("v"))
    out = dense_seq(rows, "k", "o", width=7)
    out = with_previous(out, "k", "seq", {"before": F.col("v")}, width=4)
    out = running_sum(out, "k", "seq", F.col("v"), "total", width=5)
    for k in "01":
        got = out.filter(F.col("k") == k).orderBy("seq").collect()
        values = [i for i in range(50) if i % 2 == int(k)]
        assert [r["seq"] for r in got] == list(range(25))
        assert [r["v"] for r in got] == values
        assert [r["before"] for r in got] == [None, *values[:-1]]
        assert [r["total"] for r in got] == [sum(values[: i + 1]) for i in range(25)]


def test_long_chains_are_folded_in_parts(spark, monkeypatch):
    """Chains over many parts give the groups of a walk from their start; sizes and breaks by a fixed rule."""
    monkeypatch.setattr(seg, "CHAIN_PART", 31)
    rows, want, x = [], {}, 7
    for c in range(3):
        at, total, start = 0, 0, None
        for i in range(400):
            x = (x * 1103515245 + 12345) % (1 << 31)
            n, soft = (x >> 8) % 13 + 1, i > 0 and (x >> 16) % 150 > 0
            if soft and 0 < total < 30:
                total += n
            else:
                total, start = n, at
            rows.append((f"c{c}", at, at + n - 1, n, "informative", "rule_soft" if soft else "rule_hard", 40))
            want[f"c{c}", at] = start
            at += n
    df = spark.createDataFrame(rows, "conversation_id string, start_seq long, end_seq long, n long, classification string, origin string, gap_minutes long")
    got = {(r["conversation_id"], r["start_seq"]): r["group_start"] for r in seg.merge_groups(df).collect()}
    assert got == want


def test_no_task_holds_a_hot_conversation(spark, tmp_path):
    """One conversation with nine rows in ten: no window or list of segments is keyed by the conversation alone."""
    rows = spark.createDataFrame([("hot" if i % 10 else "c", i, i, 1, "informative", "rule_soft", 40) for i in range(50)], "conversation_id string, start_seq long, end_seq long, n long, classification string, origin string, gap_minutes long")
    plan = seg.merge_groups(rows)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "collect_list(struct(start_seq" in line.replace("named_struct", "struct"):
            assert "part" in line.split("],")[0]


def test_a_replayed_batch_doubles_nothing(spark, tmp_path):
    from palim.streaming.episodes import episode_stage, forget_last_commit, read_batches

    messages = spark.createDataFrame([("a", s, "user", f"text {s}", START + timedelta(minutes=s)) for s in range(9)], "conversation_id string, seq long, role string, content string, ts timestamp")
    schema = "conversation_id string, start_seq long, end_seq long, classification string"
    path = f"file://{tmp_path}"
    for a, z in ((0, 3), (4, 8)):
        spark.createDataFrame([("a", a, z, "informative")], schema).coalesce(1).write.mode("append").parquet(f"{path}/spans")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/spans")
        query = episode_stage(stream, messages, f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.recentProgress

    assert [p["batchId"] for p in run()][:2] == [0, 1]
    before = sorted((r["id"], r["start_seq"], r["content"]) for r in read_batches(spark, f"{path}/out").collect())
    forget_last_commit(spark, f"{path}/state")
    assert run()[0]["batchId"] == 1
    assert sorted((r["id"], r["start_seq"], r["content"]) for r in read_batches(spark, f"{path}/out").collect()) == before
    assert len(before) == 2


def test_late_rows_are_kept_apart(spark, tmp_path):
    from palim.streaming.sessions import gate, sessions

    path, kinds = f"file://{tmp_path}", "conversation_id string, seq long, ts timestamp"
    pieces = [[("a", 0, 0), ("a", 1, 10), ("b", 0, 5)], [("a", 2, 300)], [("a", 3, 15), ("b", 1, 200), ("a", 4, 310)], [(None, None, 5000)]]
    for rows in pieces:
        spark.createDataFrame([(c, s, START + timedelta(minutes=m)) for c, s, m in rows], kinds).coalesce(1).write.mode("append").parquet(f"{path}/in")
        gate(spark.readStream.schema(kinds).parquet(f"{path}/in"), "2 HOURS", f"{path}/gate").option("checkpointLocation", f"{path}/g").trigger(availableNow=True).start().awaitTermination()
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(f"{path}/gate/timely")
        sessions(stream, "30 minutes", "2 hours").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/s").trigger(availableNow=True).start().awaitTermination()
    late = spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{path}/gate/late").collect()
    assert [(r["conversation_id"], r["seq"]) for r in late] == [("a", 3)]  # 285 minutes behind; b's row at 200 is 100 behind
    out = spark.read.schema("conversation_id string, n long, start_seq long, end_seq long").parquet(f"{path}/out").filter("conversation_id IS NOT NULL").collect()
    assert sorted(map(tuple, out)) == [("a", 2, 0, 1), ("a", 2, 2, 4), ("b", 1, 0, 0), ("b", 1, 1, 1)]

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palim.engine import MemoryEngine, format_memories
from palim.operators import consolidation, retrieval, review
from palim.provider import ModelError, OfflineProvider, backoff_ms, bounded_embedding, checked_embeddings, typed, with_retry

NOW = datetime(2026, 6, 1, tzinfo=timezone.utc)


def test_render():
    text = format_memories([], ["Spoken At: Jun 15, 2026 3 PM\nSam: hello", "Spoken At: Jun 16, 2026 4 PM\nEvan: hi"])
    assert text == "## Episodic Memories\nSpoken At: Jun 15, 2026 3 PM\nSam: hello\n\nSpoken At: Jun 16, 2026 4 PM\nEvan: hi"
    assert format_memories(["a", "b"], []) == "## Known Facts\n- a\n- b"
    assert format_memories([], []) == ""


@pytest.mark.parametrize(("failures", "attempts"), [(1, 2), (3, 4), (99, 4)])
def test_retry(failures, attempts):
    made = []

    def call():
        made.append(1)
        if len(made) <= failures:
            raise ModelError("busy", status=503)
        return "ok"

    if failures < attempts:
        assert with_retry(call, sleep=lambda s: None) == "ok"
    else:
        with pytest.raises(ModelError):
            with_retry(call, sleep=lambda s: None)
    assert len(made) == attempts


def test_fatal_errors_are_not_retried():
    made = []

    def call():
        made.append(1)
        raise ModelError("bad request", status=400)

    with pytest.raises(ModelError):
        with_retry(call, sleep=lambda s: None)
    assert len(made) == 1


def test_provider_rules():
    p = OfflineProvider(8)
    a, b = checked_embeddings(p, ["red apple", "apple red"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9
    assert checked_embeddings(p, []) == []
    with pytest.raises(ValueError):
        bounded_embedding([1.0], 2)
    assert [backoff_ms(i) for i in (1, 2, 3, 4)] == [1500, 3000, 6000, 10000]
    with pytest.raises(ModelError):
        typed(json.dumps({"a": 1}), ("a", "b"))


def test_limits():
    assert [retrieval.semantic_limit(n) for n in (0, 1, 1000, 1001)] == [100, 1, 1000, 100]
    assert [retrieval.recent_limit(n) for n in (0, 101, None)] == [1, 100, 10]


def _actions(spark, rows):
    return spark.createDataFrame([("e", i, *r, 0.8) for i, r in enumerate(rows)], "episode_id string, place long, kind string, fact string, category string, target_fact_id string, confidence double")


def test_normalize_actions(spark):
    run = lambda rows: [(r["kind"], r["fact"], r["category"]) for r in consolidation.normalize_actions(_actions(spark, rows)).orderBy("place").collect()]
    assert run([("update", "User lives in Tokyo", "identity", "")]) == [("new", "User lives in Tokyo", "identity")]
    assert run([("reinforce", "x", "identity", "fact-1"), ("invalidate", "x", "identity", "fact-1"), ("update", "User lives in Tokyo", "identity", "fact-1")]) == [("update", "User lives in Tokyo", "identity")]
    assert run([("new", "a", "unknown", ""), ("new", "b", "guideline", "")]) == [("new", "a", "identity"), ("new", "b", "guideline")]
    assert run([("update", "a", "goal", " "), ("update", "b", "goal", "")]) == [("new", "a", "goal")]
    assert run([("new", "  ", "goal", ""), ("reinforce", "x", "goal", ""), ("invalidate", "x", "goal", "")]) == []


def test_review_gate_and_ratings(spark):
    rows = [(k, NOW.replace(tzinfo=None) - timedelta(seconds=s), 2.0, 5.0) for k, s in (("a", -1), ("b", 0), ("c", 86399), ("d", 86400))]
    memories = spark.createDataFrame(rows, "id string, last_reviewed_at timestamp, stability double, difficulty double")
    queue = spark.createDataFrame([(1, "q1", ["d", "a", "d"], NOW), (2, "q2", ["d", "c", "b", "x"], NOW)], "id long, query string, memory_ids array<string>, created_at timestamp")
    assert [r["query"] for r in review.asked(queue).filter("memory_id = 'd'").orderBy("position").collect()] == ["q1", "q1", "q2"]
    listed = review.wanted(queue)
    due = review.eligible(listed, memories, F.lit(NOW))
    assert [r["memory_id"] for r in due.collect()] == ["d"]
    ratings = spark.createDataFrame([("d", 0, "AGAIN"), ("d", 1, "easy"), ("zz", 2, "good")], "memory_id string, place long, rating string")
    got = review.apply(due, ratings, F.lit(NOW)).collect()
    assert [(r["memory_id"], r["rating"]) for r in got] == [("d", "again")] and got[0]["stability"] < 2


def test_similarity_is_exclusive(spark):
    facts = spark.createDataFrame([("f1", "c", None, [0.5, 0.0]), ("f2", "c", None, [0.51, 0.0]), ("f3", "other", None, [1.0, 0.0])], "id string, conversation_id string, invalid_at timestamp, embedding array<float>")
    probe = spark.createDataFrame([("p", "c", [1.0, 0.0], None)], "probe_id string, conversation_id string, embedding array<float>, exclude_id string")
    assert [r["id"] for r in retrieval.similar_facts(probe, facts, 0.5).collect()] == ["f2"]


def test_engine_from_messages_to_memories(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}", OfflineProvider(16), now=lambda: NOW)
    with pytest.raises(ValueError):
        engine.import_batch_messages("c", [{"role": "user", "content": "ok"}, {"role": "user", "content": ""}])
    assert engine.add_message("c", "user", "hello there, I live in Tokyo and like green tea", 1_780_000_000_000) == {"accepted": True}
    assert engine.process() == 0  # one message is not due
    log = [{"role": "user" if i % 2 else "assistant", "content": f"message number {i} about gardens", "timestamp": 1_780_000_000_000 + i * 60_000 + (i > 7) * 86_400_000} for i in range(1, 12)]
    engine.import_batch_messages("c", log)
    assert engine.process() == 2
    status = engine.job_status("c")
    assert status["done"] and status["messages_pending"] == 0
    assert engine.table("conversation_message").agg(F.max("seq")).first()[0] == 11
    assert [(r["start_seq"], r["end_seq"]) for r in engine.table("episode_span").orderBy("start_seq").collect()] == [(0, 7), (8, 11)]
    facts, found = engine.retrieve_memory_raw("c", "gardens in Tokyo")
    assert found.count() == 2 and facts.count() >= 1
    assert engine.table("pending_review_queue").filter("consumed_at IS NULL").count() == 1
    assert engine.retrieve_memory("c", "gardens", episodic_limit=0).startswith("## Known Facts")
    assert engine.context_pre_retrieve("c", "tea").startswith("## Known Facts")
    assert engine.retrieve_memory("nobody", "tea") == ""
    assert engine.recent_memory("c").startswith("## Recent Memories\n\n### ")
    assert engine.recent_memory("nobody") == "No recent memories found.\n"
    engine._now = lambda: NOW + timedelta(days=3)
    assert engine.review() == 2
    assert engine.table("pending_review_queue").filter("consumed_at IS NULL").count() == 0
    assert engine.table("episodic_memory").filter("stability > 2.4").count() == 2
    out, facts = engine.export_memories("c", ["tea", "gardens"])
    assert out.count() == 2 and facts.count() >= 1
    with pytest.raises(ValueError):
        engine.retrieve_memory("c", " ")


class Anchoring(OfflineProvider):
    def generate_object(self, name, payload, schema=None):
        if name == "episodic_time_anchoring":
            return {"insertions": [{"line_index": i, "exact_text": "last week", "anchor_text": " week of 25 May 2026 "} for i, m in enumerate(payload["messages"]) if "last week" in m["content"]]}
        return super().generate_object(name, payload, schema)


def test_time_anchors_reach_the_content(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}", Anchoring(16), now=lambda: NOW)
    engine.import_batch_messages("c", [{"role": "Ann", "content": "we met  last week in the park", "timestamp": 0}, {"role": "Bob", "content": "indeed we did, it was nice", "timestamp": 60_000}])
    assert engine.process() == 1
    assert engine.table("episodic_memory").first()["content"] == "Spoken At: Jan 1, 1970 12 AM\nAnn: we met last week (week of 25 May 2026) in the park\nBob: indeed we did, it was nice"


class Fragile(OfflineProvider):
    """Fails while a file exists; every split proposes starts that aren't integers."""

    def __init__(self, dim, flag, name="primitive_segment_classification"):
        super().__init__(dim)
        self.flag, self.name = flag, name

    def generate_object(self, name, payload, schema=None):
        import os

        if name == self.name and os.path.exists(self.flag):
            raise ModelError("bad request", status=400)
        if name == "primitive_segment_split":
            return {"split_start_message_indices": ["no", 3]}
        if name == "episodic_title_generation":
            return {"title": " On %d messages " % len(payload["messages"])}
        return super().generate_object(name, payload, schema)


def _log(n, start=0):
    return [{"role": "user", "content": f"message number {i} about the garden", "timestamp": (start + i) * 60_000} for i in range(n)]


def test_a_failed_claim_is_given_back(spark, tmp_path):
    flag = tmp_path / "down"
    flag.write_text("")
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", Fragile(16, str(flag)), now=lambda: NOW)
    engine.import_batch_messages("c", _log(3))
    with pytest.raises(Exception):
        engine.process(retries=0)
    state = engine.table("segmentation_state").first()
    assert (state["next_segment_start_seq"], state["active_segment_start_seq"], state["eof_identified"]) == (0, None, True)
    assert engine.table("episode_span").count() == 0
    flag.unlink()
    assert engine.process() == 1
    state = engine.table("segmentation_state").first()
    assert (state["next_segment_start_seq"], state["active_segment_start_seq"], state["eof_identified"]) == (3, None, False)
    assert engine.table("episodic_memory").first()["title"] == "On 3 messages"


def test_a_commit_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", OfflineProvider(16), now=lambda: NOW, reviews=False)
    engine.import_batch_messages("c", _log(3))
    publish = engine.store._publish

    def broken(number, tables):
        if "episode_span" in tables:
            raise OSError("disk full")
        publish(number, tables)

    monkeypatch.setattr(engine.store, "_publish", broken)
    with pytest.raises(OSError):
        engine.process(retries=0)
    assert engine.table("episode_span").count() == 0 and engine.table("episodic_memory").count() == 0
    assert engine.table("segmentation_state").first()["active_segment_start_seq"] is None
    monkeypatch.setattr(engine.store, "_publish", publish)
    assert engine.process() == 1
    assert engine.table("episode_span").count() == engine.table("episodic_memory").count() == 1


def test_a_split_that_cant_be_read_leaves_one_segment(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", Fragile(16, "/nowhere"), now=lambda: NOW, reviews=False)
    engine.import_batch_messages("c", _log(25))
    assert engine.process() == 1
    status = engine.job_status("c")
    assert status == {"messages_pending": 0, "segmentation_active": False, "segmentation_jobs": 0, "episode_jobs": 0, "consolidation_jobs": 0, "done": True}


def test_another_writers_commit_is_seen(spark, tmp_path):
    from palim.sources.store import ConcurrentWrite, Store

    store = Store(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    store.commit({"t": one})
    base, _ = store.manifest()
    store.commit({"t": spark.createDataFrame([("a", 2), ("b", 1)], one.schema)}, base=base)
    with pytest.raises(ConcurrentWrite):
        store.commit({"t": one}, base=base)
    rows = lambda: sorted(tuple(r) for r in store.read("t", one.schema, "id").collect())
    assert rows() == [("a", 2), ("b", 1)]  # the last row of a key holds
    (tmp_path / "store" / "_commits" / "00000009").write_text('{"t": ["tor')  # a writer that ended half-way
    assert rows() == [("a", 2), ("b", 1)]
    monkeyed = Store.MOST_FOLDERS
    try:
        Store.MOST_FOLDERS = 1
        store.compact("t", one.schema, "id")
    finally:
        Store.MOST_FOLDERS = monkeyed
    assert rows() == [("a", 2), ("b", 1)] and len(store.manifest()[1]["t"]) == 1

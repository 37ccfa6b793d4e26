"""The memory service as a library: one method for each of its calls, tables in a Store.

Batch by batch: messages are appended, due conversations are leased and segmented, spans become episodes, episodes become
facts, and retrieved memories are reviewed. Each step is one commit; a writer that finds another's commit starts its step again. Rows come as DataFrames, markdown as strings.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim import schemas as sc
from palim.functions import fsrs
from palim.functions.ids import EPISODE_NAMESPACE, episode_id, uuid5
from palim.functions.text import anchored_messages, human_age, recent_entry, search_text, title_or_default, transcript
from palim.operators import consolidation, episodes, retrieval, review, segmentation
from palim.provider import ModelProvider, OfflineProvider, checked_embeddings, embed_column, insertions_column, proposed_actions, rated, resegmented, reviewed, titles
from palim.sources.store import ConcurrentWrite, Store, stored

_TABLES = {
    "conversation_message": sc.CONVERSATION_MESSAGE, "segmentation_state": sc.SEGMENTATION_STATE, "episode_span": sc.EPISODE_SPAN, "pending_review_queue": sc.PENDING_REVIEW,
    "episodic_memory": sc.EPISODIC_MEMORY, "semantic_memory": sc.SEMANTIC_MEMORY,
}


#: Tables of which the last row of each key holds.
_KEYS = {"segmentation_state": "conversation_id", "pending_review_queue": "id", "episodic_memory": "id", "semantic_memory": "id"}


class MemoryEngine:
    def __init__(self, spark, root: str, provider: ModelProvider | None = None, reviews: bool = True, now=None):
        """now: gives the present (UTC); fixed in tests."""
        self.spark, self.store, self.reviews = spark, Store(spark, root), reviews
        self.provider = provider or OfflineProvider()
        self._now = now or (lambda: datetime.now(timezone.utc))

    # Tables

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, _TABLES[name], _KEYS.get(name))

    def _commit(self, base: int | None = None, **changes: DataFrame) -> None:
        """Changed and new rows of several tables, in one step."""
        self.store.commit({name: rows.select(*[F.col(f.name).cast(f.dataType) for f in _TABLES[name].fields]) for name, rows in changes.items()}, base=base)
        for name in changes:
            self.store.compact(name, _TABLES[name], _KEYS.get(name))

    def now(self) -> Column:
        return F.lit(self._now())

    # Ingestion

    def add_message(self, conversation_id: str, role: str, content: str, timestamp_ms: int | None = None) -> dict:
        """Appends one message; the stream goes on."""
        return self._ingest(conversation_id, [{"role": role, "content": content, "timestamp": timestamp_ms}], eof=False)

    def import_batch_messages(self, conversation_id: str, messages: list[dict]) -> dict:
        """Appends all messages or, if a content is empty, none; the stream has ended."""
        return self._ingest(conversation_id, messages, eof=True)

    def _ingest(self, conversation_id: str, messages: list[dict], eof: bool, attempts: int = 5) -> dict:
        """Messages and state in one commit; if another writer came between, the state is read again."""
        if not messages or any(not m["content"] for m in messages):
            raise ValueError("content must not be empty")
        present = self._now()
        times = [datetime.fromtimestamp(m["timestamp"] / 1000, timezone.utc) if m.get("timestamp") is not None else present for m in messages]
        for attempt in range(attempts):
            base, _ = self.store.manifest()
            known = self.table("segmentation_state").filter(F.col("conversation_id") == conversation_id).first()
            last = known["last_message_seq"] if known else -1
            rows = [(conversation_id, last + 1 + i, m["role"], m["content"], t) for i, (m, t) in enumerate(zip(messages, times))]
            new = (conversation_id, last + len(rows), bool(eof or known and known["eof_identified"]), known["next_segment_start_seq"] if known else 0, *((known["active_segment_start_seq"], known["active_segment_end_seq"], known["active_since"]) if known else (None,) * 3))
            try:
                self._commit(base, conversation_message=self.spark.createDataFrame(rows, sc.CONVERSATION_MESSAGE), segmentation_state=self.spark.createDataFrame([new], sc.SEGMENTATION_STATE))
                return {"accepted": True}
            except ConcurrentWrite:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def messages(self, conversation_id: str, start_seq: int, end_seq: int) -> DataFrame:
        """A closed range, in order."""
        return self.table("conversation_message").filter((F.col("conversation_id") == conversation_id) & F.col("seq").between(start_seq, end_seq)).orderBy("seq")

    # Processing

    def process(self, retries: int = 1) -> int:
        """Segments all due conversations until none is due; gives the number of new spans. A failed claim is given back and taken again, `retries` times in all; then the error goes on."""
        total = failures = 0
        while True:
            try:
                made = self._process_once()
            except Exception:
                failures += 1
                if failures > retries:
                    raise
                continue
            if not made:
                break
            total += made
        if total:
            self.consolidate()
            if self.reviews:
                self.review()
        return total

    def recover_leases(self) -> int:
        stale = stored(segmentation.stale_leases(self.table("segmentation_state"), self.now()))
        n = stale.count()
        if n:
            self._commit(segmentation_state=stale.withColumns({c: F.lit(None).cast(stale.schema[c].dataType) for c in ("active_segment_start_seq", "active_segment_end_seq", "active_since")}))
        return n

    def _process_once(self) -> int:
        """Takes the leases of what is due, works, and commits spans, states and episodes in one step; a failure gives the leases back."""
        self.recover_leases()
        state, log = self.table("segmentation_state"), self.table("conversation_message").withColumnRenamed("timestamp", "ts")
        due = segmentation.claim_trigger(state, log).filter("due")
        claims = stored(due.select("conversation_id", F.col("next_segment_start_seq").alias("claim_start"), F.col("last_message_seq").alias("claim_end"), F.col("eof_identified").alias("eof")))
        if not claims.limit(1).count():
            return 0
        self._commit(segmentation_state=segmentation.taken(state, claims, self.now()))
        try:
            return self._commit_claims(claims, log)
        except Exception:
            self._commit(segmentation_state=segmentation.aborted(self.table("segmentation_state"), claims))
            raise

    def _commit_claims(self, claims: DataFrame, log: DataFrame) -> int:
        open_ = log.join(claims, "conversation_id").filter("seq BETWEEN claim_start AND claim_end")
        base = F.col("claim_start")
        claimed = stored(open_.select("conversation_id", (F.col("seq") - base).alias("seq"), "role", "content", "ts"))
        plan = segmentation.commit_plan(stored(self._merged(claimed, self._reviewed(claimed)))).join(claims, "conversation_id")
        spans = stored(
            plan.select(
                "conversation_id", (F.col("start_seq") + base).alias("start_seq"), (F.col("end_seq") + base).alias("end_seq"), "classification",
                (F.col("finalized") | F.col("eof")).alias("finalized"), "eof", (F.col("next_seq") + base).alias("open_seq"),
            )
        )
        following = spans.groupBy("conversation_id").agg(F.when(F.bool_or("eof"), F.max("end_seq") + 1).otherwise(F.max("open_seq")).alias("next"))
        done = stored(claims.join(following, "conversation_id"))
        state = self.table("segmentation_state")
        problem = segmentation.checked_claims(state, done).filter("problem IS NOT NULL").first()
        if problem:
            raise ValueError(f"{problem['problem']}: {problem['conversation_id']}")
        existing = self.table("episode_span").select("conversation_id", "start_seq")
        new = stored(spans.filter("finalized").select("conversation_id", "start_seq", "end_seq", "classification", self.now().alias("created_at")).join(existing, ["conversation_id", "start_seq"], "left_anti"))
        made = new.count()
        changes = {"segmentation_state": segmentation.committed(state, done)}
        if made:
            changes |= {"episode_span": new, "episodic_memory": self._episodes(log, new)}
        self._commit(**changes)
        return made

    def _with_messages(self, rows: DataFrame, messages: DataFrame) -> DataFrame:
        """rows (conversation_id, start_seq, end_seq) with their messages in order."""
        keys = ["conversation_id", "start_seq", "end_seq"]
        placed = episodes.in_spans(messages, rows.select(*keys)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "role", "content", "ts"))).alias("messages"))
        return rows.join(placed, keys, "left")

    def _reviewed(self, claimed: DataFrame) -> DataFrame:
        """Segments of the buckets: those of 5 to 20 messages as they are, the others by the model."""
        origin = F.when(F.col("bucket") > 0, F.concat(F.lit("rule_"), F.col("boundary")))
        gap = F.when(F.col("bucket") > 0, F.col("gap_minutes"))
        buckets = stored(segmentation.bucket_ranges(claimed).select("conversation_id", "start_seq", "end_seq", "n", origin.alias("origin"), gap.alias("gap_minutes")))
        plain = F.col("n").between(sc.CLASSIFY_MAX + 1, sc.SPLIT_ABOVE)
        easy = buckets.filter(plain).withColumn("classification", F.lit("informative"))
        return easy.unionByName(reviewed(self._with_messages(buckets.filter(~plain), claimed), self.provider))

    def _merged(self, claimed: DataFrame, segments: DataFrame) -> DataFrame:
        """Groups of several segments are segmented anew by the model."""
        groups = stored(segmentation.grouped(segments))
        anew = resegmented(self._with_messages(groups.filter("parts > 1"), claimed), self.provider)
        return groups.filter("parts = 1").select("conversation_id", "start_seq", "end_seq", "classification").unionByName(anew)

    def _episodes(self, log: DataFrame, spans: DataFrame) -> DataFrame:
        made = insertions_column(stored(episodes.insert_new(self.table("episodic_memory"), episodes.materialize(log, spans))), "messages", self.provider)
        made = made.withColumn("content", transcript(anchored_messages(F.col("messages"), F.col("insertions"))))
        made = stored(made.drop("title"))
        made = made.join(titles(made, self.provider), "id")
        inner = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["ts"].alias("timestamp")))
        rows = made.withColumns({"messages": inner, "title": title_or_default(F.col("title")), "created_at": F.col("end_at"), "last_reviewed_at": F.col("end_at"), "consolidated_at": F.lit(None).cast("timestamp")})
        return embed_column(rows.drop("insertions"), "content", self.provider)

    def consolidate(self) -> int:
        """Facts of all informative episodes not consolidated yet; gives their number. A round takes the next episode of every conversation, so that rounds follow the longest queue, not the episodes."""
        total = 0
        while made := self._consolidate_round():
            total += made
        return total

    def _consolidate_round(self) -> int:
        """Related facts (20 at most) are loaded, the model's actions applied in order, and facts and episodes committed in one step."""
        memories, facts = self.table("episodic_memory"), self.table("semantic_memory")
        waiting = episodes.to_consolidate(memories)
        first = waiting.groupBy("conversation_id").agg(F.min(F.struct("start_at", "id")).alias("f")).select(F.col("f.id").alias("id"))
        batch = stored(waiting.join(first, "id", "left_semi"))
        n = batch.count()
        if not n:
            return 0
        asked = batch.select(F.col("id").alias("query_id"), "conversation_id", F.col("content").alias("text"), "embedding")
        found = stored(retrieval.semantic(facts.withColumn("search_text", F.col("fact")), asked, sc.ACTION_FACTS).join(facts.select("id", "category", "fact"), "id"))
        related = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "category", "fact"))).alias("related"))
        chosen = consolidation.pick_for_prediction(found).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "category", "fact"))).alias("chosen"))
        said = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("ts")))
        calls = batch.select("id", "title", said.alias("messages")).join(related.withColumnRenamed("query_id", "id"), "id", "left").join(chosen.withColumnRenamed("query_id", "id"), "id", "left")
        actions = stored(proposed_actions(calls, self.provider))
        changes = {"episodic_memory": batch.withColumn("consolidated_at", self.now())}
        if actions.limit(1).count():
            changes["semantic_memory"] = self._changed_facts(batch, facts, found, actions)
        self._commit(**changes)
        return n

    def _changed_facts(self, batch: DataFrame, facts: DataFrame, found: DataFrame, actions: DataFrame) -> DataFrame:
        """New facts and those that the actions change."""
        order = Window.partitionBy("episode_id").orderBy("targeted", "place")
        normal = consolidation.normalize_actions(actions).withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("targeted")
        tells = F.col("kind").isin("new", "update")
        told = embed_column(normal.filter(tells), "fact", self.provider)
        normal = told.unionByName(normal.filter(~tells), allowMissingColumns=True)
        episodes_ = batch.select(F.col("id").alias("episode_id"), "conversation_id")
        scope = found.select(F.col("query_id").alias("episode_id"), "id").join(episodes_, "episode_id").select("conversation_id", "episode_id", "id")
        placed = normal.join(episodes_, "episode_id").withColumn("episode_pos", F.lit(0).cast("long"))
        inputs = facts.join(batch.select("conversation_id"), "conversation_id", "left_semi").select("conversation_id", "id", "category", "fact", F.col("source_episodic_ids").alias("sources"), F.col("invalid_at").isNull().alias("valid"), "embedding")
        cols = ("conversation_id", "episode_id", "episode_pos", "place", "kind", "fact", "category", "target_fact_id", "embedding")
        after = stored(consolidation.apply_actions(inputs, placed.select(*cols), scope))
        state = after.select("id", F.col("sources").alias("new_sources"), "active")
        changed = facts.join(state, "id").filter((F.size("new_sources") != F.size("source_episodic_ids")) | (~F.col("active") & F.col("invalid_at").isNull()))
        changed = changed.withColumns({"source_episodic_ids": F.col("new_sources"), "invalid_at": F.when(~F.col("active") & F.col("invalid_at").isNull(), self.now()).otherwise(F.col("invalid_at"))})
        new = after.join(facts.select("id"), "id", "left_anti").withColumn("episode_id", F.get("sources", F.lit(0))).join(batch.select(F.col("id").alias("episode_id"), episodes.valid_at(F.col("start_at"), F.col("end_at")).alias("valid_at")), "episode_id")
        new = new.withColumns({"id": uuid5(EPISODE_NAMESPACE, F.col("id")), "source_episodic_ids": F.col("sources"), "invalid_at": F.when(~F.col("active"), self.now()), "created_at": self.now()})
        names = sc.SEMANTIC_MEMORY.fieldNames()
        return changed.select(*names).unionByName(new.select(*names))

    def review(self) -> int:
        """Rates the memories that were retrieved; gives how many ratings there are. New states and the drained queue are one commit."""
        queue, memories = self.table("pending_review_queue"), self.table("episodic_memory")
        waiting = queue.filter("consumed_at IS NULL")
        if not waiting.limit(1).count():
            return 0
        due = stored(review.eligible(review.wanted(waiting), memories, self.now()).select("memory_id", "stability", "difficulty", "days"))
        given = stored(rated(due, self.provider))
        new = review.apply(due, given, self.now()).select(F.col("memory_id").alias("id"), F.col("stability").alias("s"), F.col("difficulty").alias("d"), F.col("last_reviewed_at").alias("t"))
        reviewed_ = memories.join(new, "id").withColumns({"stability": F.col("s"), "difficulty": F.col("d"), "last_reviewed_at": F.col("t")})
        self._commit(episodic_memory=reviewed_, pending_review_queue=review.drain(waiting, self.now()))
        return given.count()

    # Retrieval

    def _query(self, conversation_id: str, query: str, embedding: list[float] | None) -> DataFrame:
        if not query.strip():
            raise ValueError("query must not be empty")
        vector = embedding if embedding is not None else checked_embeddings(self.provider, [query])[0]
        return self.spark.createDataFrame([("q", conversation_id, query, vector)], "query_id string, conversation_id string, text string, embedding array<float>")

    def _semantic(self, asked: DataFrame, limit: int, category: str | None) -> DataFrame:
        facts = self.table("semantic_memory")
        found = retrieval.semantic(facts.withColumn("search_text", F.col("fact")), asked, limit, category)
        return facts.join(F.broadcast(found.select("id", "rank", "score")), "id").drop("embedding").orderBy("rank")

    def _episodic(self, asked: DataFrame, limit: int) -> DataFrame:
        memories = self.table("episodic_memory")
        found = retrieval.episodic(memories.withColumn("search_text", search_text(F.col("title"), F.col("content"))), asked, self.now(), limit)
        return memories.join(F.broadcast(found.select("id", "rank", "score")), "id").drop("embedding").withColumn("consolidated_at", F.lit(None).cast("timestamp")).orderBy("rank")

    def retrieve_memory_raw(self, conversation_id: str, query: str, embedding: list[float] | None = None, episodic_limit: int = sc.EPISODIC_LIMIT, semantic_limit: int = sc.SEMANTIC_LIMIT, category: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(facts, episodes) with scores; what episodes were found waits for review. The category is the facts' only."""
        asked = self._query(conversation_id, query, embedding)
        facts, found = self._semantic(asked, semantic_limit, category), self._episodic(asked, episodic_limit)
        ids = [r["id"] for r in found.select("id").collect()] if self.reviews else []  # at most episodic_limit
        if ids:
            row = (str(uuid.uuid4()), conversation_id, query, ids, self._now(), None)
            self._commit(pending_review_queue=self.spark.createDataFrame([row], sc.PENDING_REVIEW))
        return facts, found

    def retrieve_memory(self, conversation_id: str, query: str, **options) -> str:
        facts, found = self.retrieve_memory_raw(conversation_id, query, **options)
        return format_memories([r["fact"] for r in facts.collect()], [r["content"] for r in found.collect()])

    def context_pre_retrieve(self, conversation_id: str, query: str, embedding: list[float] | None = None, semantic_limit: int = sc.SEMANTIC_LIMIT, category: str | None = None) -> str:
        """Facts only, without a review."""
        return format_memories([r["fact"] for r in self._semantic(self._query(conversation_id, query, embedding), semantic_limit, category).collect()], [])

    def recent_memory_raw(self, conversation_id: str, days: int | None = None, limit: int | None = None) -> DataFrame:
        rows = self.table("episodic_memory").filter(F.col("conversation_id") == conversation_id).drop("embedding")
        return retrieval.recent(rows, self.now(), days, limit)

    def recent_memory(self, conversation_id: str, days: int | None = None, limit: int | None = None) -> str:
        age = F.greatest(F.lit(0).cast("long"), F.unix_seconds(self.now()) - F.unix_seconds("created_at"))
        rows = self.recent_memory_raw(conversation_id, days, limit).withColumn("age", human_age(age)).withColumn("entry", recent_entry(F.col("title"), F.col("surprise"), F.col("age"), F.col("content"))).collect()
        if not rows:
            return "No recent memories found.\n"
        return ("## Recent Memories\n\n" + "\n".join(r["entry"] for r in rows)).rstrip()

    def job_status(self, conversation_id: str) -> dict:
        """What is still to do for a conversation, by kind of work; stale leases are recovered first."""
        self.recover_leases()
        mine = F.col("conversation_id") == conversation_id
        state = self.table("segmentation_state").filter(mine).first()
        pending = max(0, state["last_message_seq"] - state["next_segment_start_seq"] + 1) if state else 0
        active = bool(state and state["active_segment_start_seq"] is not None)
        memories = self.table("episodic_memory").filter(mine)
        made = memories.select(F.col("id"))
        missing = self.table("episode_span").filter(mine).select(episode_id(F.col("conversation_id"), F.col("start_seq")).alias("id")).join(made, "id", "left_anti").count()
        waiting = episodes.to_consolidate(memories).count()
        done = pending == 0 and not active and missing == 0 and waiting == 0
        return {"messages_pending": pending, "segmentation_active": active, "segmentation_jobs": int(active), "episode_jobs": missing, "consolidation_jobs": waiting, "done": done}

    def export_memories(self, conversation_id: str, queries: list[str]) -> tuple[DataFrame, DataFrame]:
        """(episodes, facts): the recent 100 and what a sweep of queries finds, each once."""
        found, facts = self.recent_memory_raw(conversation_id, None, 100), None
        for q in queries:
            part = self._semantic(self._query(conversation_id, q, None), sc.SEMANTIC_LIMIT, None).drop("rank", "score")
            facts = part if facts is None else facts.unionByName(part)
        return found.dropDuplicates(["id"]), facts.dropDuplicates(["id"]) if facts is not None else self.table("semantic_memory").limit(0).drop("embedding")


def format_memories(facts: list[str], contents: list[str]) -> str:
    """Episodes as blocks, then facts as a list."""
    out = ""
    if contents:
        out += "## Episodic Memories\n" + "".join(f"{c}\n\n" for c in contents)
    if facts:
        out += "## Known Facts\n" + "".join(f"- {f}\n" for f in facts)
    return out.rstrip()


INITIAL_STATE = {"stability": fsrs.INITIAL_STABILITY, "difficulty": fsrs.INITIAL_DIFFICULTY}

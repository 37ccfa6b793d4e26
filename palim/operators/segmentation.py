"""Segmentation of message streams: gaps, buckets, primitive review, merge sweep and commit plan.

Messages have conversation_id, seq (dense from 0), role, content, ts. Segments have conversation_id, idx, start_seq,
end_seq, classification, origin (of the boundary before them; null for the first) and gap_minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palim.operators.ordered import dense_seq, running_sum, with_previous
from palim.schemas import CLASSIFY_MAX, HARD_GAP_MINUTES, LEASE_MINUTES, MERGE_BELOW, SOFT_GAP_MINUTES, SPLIT_ABOVE, TRIGGER_MESSAGES
from palim.sources.store import stored

#: The offline stand-ins for model calls: a segment with fewer characters is low_info; a split is at every so many messages.
STUB_LOW_INFO_CHARS = 40
STUB_SPLIT_EVERY = 12


def boundary_type(gap_us: Column) -> Column:
    """none below 30 minutes, soft from there to 3 hours with both ends, hard above; negative gaps never split."""
    return F.when(gap_us > HARD_GAP_MINUTES * 60_000_000, "hard").when(gap_us >= SOFT_GAP_MINUTES * 60_000_000, "soft").otherwise("none")


def adjacent_gaps(messages: DataFrame) -> DataFrame:
    """Each message with the gap to the one before (null for the first), in microseconds and whole minutes, and its boundary type."""
    paired = with_previous(messages, "conversation_id", "seq", {"previous_ts": F.col("ts")})
    gap = F.unix_micros("ts") - F.unix_micros("previous_ts")
    return paired.withColumn("gap_us", gap).withColumn("gap_minutes", (F.col("gap_us") / 60_000_000).cast("long")).withColumn("boundary", boundary_type(F.col("gap_us")))


def temporal_boundaries(messages: DataFrame) -> DataFrame:
    gaps = adjacent_gaps(messages).filter("boundary <> 'none'")
    return gaps.select("conversation_id", (F.col("seq") - 1).alias("left_end_seq"), F.col("seq").alias("right_start_seq"), "boundary", "gap_minutes")


def bucketed(messages: DataFrame) -> DataFrame:
    """Messages with their bucket (0 first) in the conversation."""
    gaps = adjacent_gaps(messages)
    return running_sum(gaps, "conversation_id", "seq", (F.col("boundary") != "none").cast("long"), "bucket")


def bucket_ranges(messages: DataFrame) -> DataFrame:
    """One row for each bucket: its range, size, characters, and the rule boundary before it."""
    return bucketed(messages).groupBy("conversation_id", "bucket").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"),
        F.min_by("boundary", "seq").alias("boundary"), F.min_by("gap_minutes", "seq").alias("gap_minutes"),
    )


def split_ranges(n: Column, starts: Column) -> Column:
    """Ranges (first, last) of n messages from start indices: 0 and out-of-range ones are ignored, the rest sorted and made distinct."""
    inner = F.array_sort(F.array_distinct(F.filter(starts.cast("array<long>"), lambda i: (i > 0) & (i < n))))
    first = F.concat(F.array(F.lit(0).cast("long")), inner)
    after = F.concat(inner, F.array(n.cast("long")))
    return F.zip_with(first, after, lambda a, b: F.struct(a.alias("first"), (b - 1).alias("last")))


def resolve_plan(n: Column, items: Column) -> Column:
    """Items (start, surprise) to contiguous ranges: out-of-range starts are ignored, the first of equal starts holds, a missing 0 is `low`."""
    inside = F.filter(items, lambda x: (x["start"] >= 0) & (x["start"] < n))
    distinct = F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["start"].cast("long"))))
    starts = F.when(F.array_contains(distinct, F.lit(0).cast("long")), distinct).otherwise(F.concat(F.array(F.lit(0).cast("long")), distinct))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            s.alias("first"), (F.coalesce(F.get(starts, i + 1), n.cast("long")) - 1).alias("last"),
            F.coalesce(F.get(F.filter(inside, lambda x: x["start"] == s), 0)["surprise"], F.lit("low")).alias("surprise"),
        ),
    )


def primitive_review(messages: DataFrame) -> DataFrame:
    """Buckets of up to 4 messages are classified, up to 20 informative, larger ones split (children of up to 4 classified).

    Messages are summed by bucket and twelfth before they meet the bucket's size, so no bucket is gathered in a task.
    """
    dealt = bucketed(messages)
    buckets = dealt.groupBy("conversation_id", "bucket").agg(F.min("seq").alias("bucket_start"), F.count(F.lit(1)).alias("bucket_n"))
    placed = dealt.join(buckets, ["conversation_id", "bucket"])
    child = F.when(F.col("bucket_n") > SPLIT_ABOVE, F.floor((F.col("seq") - F.col("bucket_start")) / STUB_SPLIT_EVERY)).otherwise(F.lit(0))
    parts = placed.groupBy("conversation_id", "bucket", child.cast("long").alias("child")).agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"),
        F.min_by("boundary", "seq").alias("boundary"), F.min_by("gap_minutes", "seq").alias("gap"),
    )
    low = (F.col("n") <= CLASSIFY_MAX) & (F.col("n_chars") < STUB_LOW_INFO_CHARS)
    origin = F.when(F.col("child") > 0, "llm_locked").when(F.col("bucket") > 0, F.concat(F.lit("rule_"), F.col("boundary")))
    return parts.select(
        "conversation_id", "start_seq", "end_seq", "n", F.when(low, "low_info").otherwise("informative").alias("classification"), origin.alias("origin"),
        F.when((F.col("child") == 0) & (F.col("bucket") > 0), F.col("gap")).alias("gap_minutes"),
    )


#: Segments of a chain that are folded together; a group has MERGE_BELOW segments at most, so it spans two such parts at most.
CHAIN_PART = 4096


def merge_groups(segments: DataFrame) -> DataFrame:
    """Segments with `group_start`: informative segments join over soft boundaries while their total is below 30.

    Only chains of informative segments with soft boundaries can join. A chain is dealt out in parts. What a part hands on
    is the total of its open group, which depends on the total handed to it (0: no open group, or 1 to 29); a part is
    folded once for each of these, the parts of a chain are then put together by those few numbers, and folded for good.
    """
    dense = dense_seq(stored(segments), "conversation_id", "start_seq", "__idx")
    paired = with_previous(dense, "conversation_id", "__idx", {"kind_before": F.col("classification")})
    joined = F.coalesce((F.col("classification") == "informative") & (F.col("kind_before") == "informative") & (F.col("origin") == "rule_soft"), F.lit(False))
    chained = stored(running_sum(paired.withColumn("__joined", joined).drop("kind_before"), "conversation_id", "__idx", (~F.col("__joined")).cast("long"), "chain"))
    first = chained.filter(~F.col("__joined")).select("conversation_id", "chain", F.col("__idx").alias("__first"))
    placed = chained.join(first, ["conversation_id", "chain"]).withColumn("part", F.floor((F.col("__idx") - F.col("__first")) / CHAIN_PART))
    fields = ("start_seq", "end_seq", "n", "classification", "origin", "gap_minutes")
    parts = stored(placed.groupBy("conversation_id", "chain", "part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts")))

    def total_after(total: Column, n: Column) -> Column:
        """The open group's total after a segment; 0 once it is full."""
        new = F.when(total > 0, total + n).otherwise(n)
        return F.when(new < MERGE_BELOW, new).otherwise(F.lit(0).cast("long"))

    # What each part that another one follows makes of each total, and the total that each part begins with.
    several = parts.filter(F.col("part") > 0).select("conversation_id", "chain").distinct()
    totals = F.array(*[F.lit(t).cast("long") for t in range(MERGE_BELOW)])
    after = F.aggregate("parts", totals, lambda state, p: F.transform(state, lambda t: total_after(t, p["n"])))
    maps = parts.join(several, ["conversation_id", "chain"], "left_semi").select("conversation_id", "chain", F.struct("part", after.alias("map")).alias("m"))
    maps = maps.groupBy("conversation_id", "chain").agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["map"]).alias("maps"))
    none = F.array(F.lit(0).cast("long"))
    given = F.aggregate("maps", none, lambda state, m: F.concat(state, F.array(F.get(m, F.element_at(state, -1).cast("int")))))
    given = maps.select("conversation_id", "chain", F.posexplode(given).alias("part", "given"))
    empty = F.struct(F.col("given").alias("total"), F.lit(None).cast("long").alias("start"), F.array().cast("array<bigint>").alias("starts"))

    def fold(state: Column, part: Column) -> Column:
        start = F.when(state["total"] > 0, state["start"]).otherwise(part["start_seq"])
        return F.struct(total_after(state["total"], part["n"]).alias("total"), start.alias("start"), F.concat(state["starts"], F.array(start)).alias("starts"))

    begun = parts.join(given.withColumn("part", F.col("part").cast("long")), ["conversation_id", "chain", "part"], "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long")))
    folded = begun.withColumn("starts", F.aggregate("parts", empty, fold, lambda s: s["starts"]))
    # A group that goes on from the part before begins where that part's last group does.
    handed = folded.join(several, ["conversation_id", "chain"], "left_semi").select("conversation_id", "chain", (F.col("part") + 1).alias("part"), F.array_max("starts").alias("handed"))
    rows = folded.join(handed, ["conversation_id", "chain", "part"], "left").select("conversation_id", "handed", F.explode(F.arrays_zip("parts", "starts")).alias("x"))
    return rows.select("conversation_id", "x.parts.*", F.coalesce("x.starts", "handed").alias("group_start"))


def grouped(segments: DataFrame) -> DataFrame:
    """A row for each group of merge_groups: its range, messages and parts."""
    return merge_groups(segments).groupBy("conversation_id", F.col("group_start").alias("start_seq")).agg(
        F.max("end_seq").alias("end_seq"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.min_by("classification", "start_seq").alias("classification"),
    )


def merge_sweep(segments: DataFrame) -> DataFrame:
    """Final segments: a group of two or more is split anew (by the stand-in, every 12 messages) into informative segments."""
    groups = grouped(segments)
    starts = F.when(F.col("parts") > 1, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STUB_SPLIT_EVERY).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    ranges = groups.select("conversation_id", "start_seq", "classification", F.explode(split_ranges(F.col("n"), starts)).alias("r"))
    return ranges.select("conversation_id", (F.col("start_seq") + F.col("r.first")).alias("start_seq"), (F.col("start_seq") + F.col("r.last")).alias("end_seq"), "classification")


def commit_plan(segments: DataFrame, eof: bool = False) -> DataFrame:
    """Segments with `finalized` and the conversation's `next_seq`: the last segment stays open unless the stream has ended."""
    last = segments.groupBy("conversation_id").agg(F.max("start_seq").alias("last_start"), F.max("end_seq").alias("last_end"))
    both = segments.join(last, "conversation_id")
    if eof:
        return both.select(*segments.columns, F.lit(True).alias("finalized"), (F.col("last_end") + 1).alias("next_seq"))
    return both.select(*segments.columns, (F.col("start_seq") < F.col("last_start")).alias("finalized"), F.col("last_start").alias("next_seq"))


def pending_count(last_seq: Column, next_seq: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), last_seq - next_seq + 1)


def claim_trigger(state: DataFrame, messages: DataFrame) -> DataFrame:
    """State rows with pending messages, whether a gap of 30 minutes is among them, and whether a claim is due."""
    gaps = adjacent_gaps(messages).join(state.select("conversation_id", "next_segment_start_seq", "last_message_seq"), "conversation_id")
    inside = (F.col("seq") > F.col("next_segment_start_seq")) & (F.col("seq") <= F.col("last_message_seq"))
    split = gaps.groupBy("conversation_id").agg(F.bool_or(inside & (F.col("gap_us") >= SOFT_GAP_MINUTES * 60_000_000)).alias("has_gap"))
    both = state.join(split, "conversation_id", "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    both = both.withColumn("pending", pending_count(F.col("last_message_seq"), F.col("next_segment_start_seq")))
    due = (
        (F.col("last_message_seq") >= F.col("next_segment_start_seq"))
        & F.col("active_segment_start_seq").isNull()
        & (F.col("eof_identified") | (F.col("pending") >= TRIGGER_MESSAGES) | F.col("has_gap"))
    )
    return both.withColumn("due", due)


def stale_leases(state: DataFrame, now: Column) -> DataFrame:
    """Active states whose lease is older than 120 minutes, as they are after recovery."""
    stale = state.filter(F.col("active_segment_start_seq").isNotNull() & (F.col("active_since") < now - F.make_dt_interval(mins=F.lit(LEASE_MINUTES))))
    return stale.withColumn("next_segment_start_seq", F.col("active_segment_start_seq"))


def checked_claims(state: DataFrame, claims: DataFrame) -> DataFrame:
    """claims: conversation_id, claim_start, claim_end, next. Adds `problem`: null if the active lease is the claim's and the next segment starts in the claim or right behind it."""
    mismatch = ~(F.col("active_segment_start_seq").eqNullSafe(F.col("claim_start")) & F.col("active_segment_end_seq").eqNullSafe(F.col("claim_end")))
    outside = ~F.col("next").between(F.col("claim_start"), F.col("claim_end") + 1)
    lease = state.select("conversation_id", "active_segment_start_seq", "active_segment_end_seq")
    return claims.join(lease, "conversation_id", "left").withColumn("problem", F.when(mismatch, "claim mismatch").when(outside, "next outside the claim"))


def taken(state: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """The states of claims (conversation_id, claim_start, claim_end) with the lease taken."""
    return state.join(claims.select("conversation_id", "claim_start", "claim_end"), "conversation_id").withColumns({"active_segment_start_seq": F.col("claim_start"), "active_segment_end_seq": F.col("claim_end"), "active_since": now})


def _released(state: DataFrame, claims: DataFrame, next_seq: Column) -> DataFrame:
    """The states whose active lease is the claim's, without it."""
    both = state.join(claims, "conversation_id").filter((F.col("active_segment_start_seq") == F.col("claim_start")) & (F.col("active_segment_end_seq") == F.col("claim_end")))
    none = {c: F.lit(None).cast(state.schema[c].dataType) for c in ("active_segment_start_seq", "active_segment_end_seq", "active_since")}
    return both.withColumns({"next_segment_start_seq": next_seq, **none})


def committed(state: DataFrame, claims: DataFrame) -> DataFrame:
    """The states after claims (with next) are done: the lease goes, and so does the end mark."""
    return _released(state, claims, F.col("next")).withColumn("eof_identified", F.lit(False))


def aborted(state: DataFrame, claims: DataFrame) -> DataFrame:
    """The states after claims have failed: they start again where they began. Where another claim is active, nothing changes."""
    return _released(state, claims, F.col("claim_start"))


def legacy_time_gap(messages: DataFrame, minutes: int = SOFT_GAP_MINUTES) -> DataFrame:
    """The older segmenter: a new segment where a gap is more than 30 minutes."""
    gaps = adjacent_gaps(messages)
    split = F.coalesce(F.col("gap_us") > minutes * 60_000_000, F.lit(False))
    dealt = running_sum(gaps.withColumn("split", split), "conversation_id", "seq", F.col("split").cast("long"), "segment")
    return dealt.groupBy("conversation_id", "segment").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count(F.lit(1)).alias("n"), F.when(F.col("segment") > 0, "time_gap").otherwise("start").alias("reason")
    )

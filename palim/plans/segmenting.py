"""Queries on message streams: ingestion, segmentation, episodes, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palim.functions.ids import EPISODE_NAMESPACE, episode_id
from palim.functions.text import apply_anchors, message_lines, token_estimate, valid_anchor
from palim.operators import episodes as ep
from palim.operators import segmentation as seg
from palim.operators.ordered import running_sum
from palim.sources import adapters as ad
from palim.sources.adapters import sql
from palim.sources.store import scratch_folder, stored
from palim.shipping import ship
from palim.streaming.episodes import episode_stage, forget_last_commit, read_batches
from palim.streaming.segments import OUTPUT, stream_spans
from palim.streaming.sessions import gate, sessions

_GAPS = """SELECT *, lag(ts) OVER (PARTITION BY conversation_id ORDER BY seq) AS previous_ts FROM {view}"""
_TYPED = """SELECT *, CASE WHEN gap_us > 10800000000 THEN 'hard' WHEN gap_us >= 1800000000 THEN 'soft' ELSE 'none' END AS boundary, CAST(trunc(gap_us / 60000000.0) AS BIGINT) AS gap_minutes
    FROM (SELECT *, date_diff('microsecond', previous_ts, ts) AS gap_us FROM gaps)"""
_BUCKETED = "SELECT *, sum(CASE WHEN boundary <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY seq) AS bucket FROM typed"
_BUCKETS = """SELECT conversation_id, bucket, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n, sum(length(content)) AS n_chars, arg_min(boundary, seq) AS boundary, arg_min_null(gap_minutes, seq) AS gap_minutes
    FROM bucketed GROUP BY 1, 2"""
_SEGMENTS = """SELECT conversation_id, start_seq, end_seq, n, CASE WHEN n <= 4 AND n_chars < 40 THEN 'low_info' ELSE 'informative' END AS classification,
    CASE WHEN child > 0 THEN 'llm_locked' WHEN bucket > 0 THEN 'rule_' || boundary END AS origin, CASE WHEN child = 0 AND bucket > 0 THEN gap END AS gap_minutes
    FROM (SELECT b.conversation_id, b.bucket, CASE WHEN r.n > 20 THEN (b.seq - r.start_seq) // 12 ELSE 0 END AS child, min(b.seq) AS start_seq, max(b.seq) AS end_seq, count(*) AS n, sum(length(b.content)) AS n_chars,
    arg_min(b.boundary, b.seq) AS boundary, arg_min(b.gap_minutes, b.seq) AS gap FROM bucketed b JOIN buckets r USING (conversation_id, bucket) GROUP BY 1, 2, 3)"""
_ORDERED = "SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY start_seq) AS idx, lag(classification) OVER (PARTITION BY conversation_id ORDER BY start_seq) AS before FROM segments"
_FOLD = """SELECT conversation_id, idx, start_seq, end_seq, n, classification, start_seq AS group_start, n AS total FROM ordered WHERE idx = 1
    UNION ALL SELECT o.conversation_id, o.idx, o.start_seq, o.end_seq, o.n, o.classification,
    CASE WHEN o.classification = 'informative' AND o.before = 'informative' AND o.origin = 'rule_soft' AND f.total < 30 THEN f.group_start ELSE o.start_seq END,
    CASE WHEN o.classification = 'informative' AND o.before = 'informative' AND o.origin = 'rule_soft' AND f.total < 30 THEN f.total + o.n ELSE o.n END
    FROM fold f JOIN ordered o ON o.conversation_id = f.conversation_id AND o.idx = f.idx + 1"""
_FINAL = """SELECT conversation_id, group_start + s AS start_seq, least(group_start + s + step - 1, group_end) AS end_seq, classification
    FROM (SELECT *, unnest(range(0, n, step)) AS s FROM (SELECT conversation_id, group_start, max(end_seq) AS group_end, CAST(sum(n) AS BIGINT) AS n, arg_min(classification, start_seq) AS classification,
    CASE WHEN count(*) > 1 THEN 12 ELSE CAST(sum(n) AS BIGINT) END AS step FROM fold GROUP BY 1, 2))"""


def _chain(view: str, upto: str) -> dict[str, str]:
    steps = {"gaps": _GAPS.format(view=view), "typed": _TYPED, "bucketed": _BUCKETED, "buckets": _BUCKETS, "segments": _SEGMENTS, "ordered": _ORDERED, "fold": _FOLD, "final": _FINAL}
    out = {}
    for k, v in steps.items():
        out[k] = v
        if k == upto:
            break
    return out


def range_scan_messages(spark, sf_dir) -> DataFrame:
    return ad.msg_dense(spark, sf_dir).filter(F.col("seq").between(10, 29)).select("conversation_id", "seq", "role", "content")


def seq_assignment(spark, sf_dir) -> DataFrame:
    return ad.msg_dense(spark, sf_dir).select("conversation_id", (F.col("seq") + 1000).alias("seq"), F.unix_micros("ts").alias("us"))


def adjacent_gaps(spark, sf_dir) -> DataFrame:
    return seg.adjacent_gaps(ad.msg_hard(spark, sf_dir)).select("conversation_id", "seq", "gap_us", "gap_minutes", "boundary")


def temporal_boundaries(spark, sf_dir) -> DataFrame:
    return seg.temporal_boundaries(ad.msg_conv(spark, sf_dir))


def bucket_ranges(spark, sf_dir) -> DataFrame:
    return seg.bucket_ranges(ad.msg_dense(spark, sf_dir))


def primitive_review(spark, sf_dir) -> DataFrame:
    return seg.primitive_review(ad.msg_dense(spark, sf_dir))


def split_ranges(spark, sf_dir) -> DataFrame:
    buckets = seg.bucket_ranges(ad.msg_dense(spark, sf_dir)).filter("n > 4")
    starts = F.array(F.col("n") + 5, F.lit(3), F.lit(0), F.lit(3), F.lit(1), F.floor(F.col("n") / 2))
    rows = buckets.select("conversation_id", "start_seq", F.explode(seg.split_ranges(F.col("n"), starts)).alias("r"))
    return rows.select("conversation_id", (F.col("start_seq") + F.col("r.first")).alias("first_seq"), (F.col("start_seq") + F.col("r.last")).alias("last_seq"))


def merge_groups(spark, sf_dir) -> DataFrame:
    return seg.merge_groups(seg.primitive_review(ad.msg_dense(spark, sf_dir))).select("conversation_id", "start_seq", "end_seq", "group_start")


def merge_sweep(spark, sf_dir) -> DataFrame:
    return seg.merge_sweep(seg.primitive_review(ad.msg_dense(spark, sf_dir)))


def commit_plan(spark, sf_dir) -> DataFrame:
    return seg.commit_plan(seg.merge_sweep(seg.primitive_review(ad.msg_dense(spark, sf_dir))))


def commit_plan_eof(spark, sf_dir) -> DataFrame:
    return seg.commit_plan(seg.merge_sweep(seg.primitive_review(ad.msg_hard(spark, sf_dir))), eof=True)


def claim_trigger(spark, sf_dir) -> DataFrame:
    return seg.claim_trigger(ad.states(spark, sf_dir), ad.msg_user(spark, sf_dir)).select("conversation_id", "pending", "has_gap", "due")


def stale_leases(spark, sf_dir) -> DataFrame:
    return seg.stale_leases(ad.states(spark, sf_dir), ad.now()).select("conversation_id", "next_segment_start_seq", "last_message_seq")


def processing_status(spark, sf_dir) -> DataFrame:
    state = ad.states(spark, sf_dir)
    pending = seg.pending_count(F.col("last_message_seq"), F.col("next_segment_start_seq"))
    active = F.col("active_segment_start_seq").isNotNull()
    return state.select("conversation_id", pending.alias("pending"), active.alias("active"), (~active & (pending == 0)).alias("done"))


def legacy_time_gap(spark, sf_dir) -> DataFrame:
    return seg.legacy_time_gap(ad.msg_hard(spark, sf_dir))


def session_window_gap(spark, sf_dir) -> DataFrame:
    rows = ad.msg_hard(spark, sf_dir)
    return rows.groupBy("conversation_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq")).drop("session_window")


def _episodes(spark, sf_dir) -> DataFrame:
    messages = ad.msg_conv(spark, sf_dir)
    spans = seg.merge_sweep(seg.primitive_review(messages))
    return ep.materialize(messages, spans)


def episode_materialize(spark, sf_dir) -> DataFrame:
    return _episodes(spark, sf_dir).select(
        "id", "conversation_id", "start_seq", "end_seq", "classification", "title", F.size("messages").cast("long").alias("n"), F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"),
        F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"),
    )


def render_transcript(spark, sf_dir) -> DataFrame:
    return _episodes(spark, sf_dir).select("conversation_id", "start_seq", "content")


def prompt_lines(spark, sf_dir) -> DataFrame:
    return _episodes(spark, sf_dir).select("conversation_id", "start_seq", message_lines(F.col("messages"), "numbered").alias("numbered"), message_lines(F.col("messages"), "indexed").alias("indexed"))


def uuid5_ids(spark, sf_dir) -> DataFrame:
    return seg.bucket_ranges(ad.msg_dense(spark, sf_dir)).select("conversation_id", "start_seq", episode_id(F.col("conversation_id"), F.col("start_seq")).alias("id"))


def stale_jobs(spark, sf_dir) -> DataFrame:
    spans = seg.bucket_ranges(ad.msg_dense(spark, sf_dir)).select("conversation_id", "start_seq", "end_seq")
    jobs = spans.select("conversation_id", (F.col("start_seq") + F.when(F.col("start_seq") % 7 == 0, 1).otherwise(0)).alias("start_seq"), (F.col("end_seq") + F.when(F.col("end_seq") % 5 == 0, 1).otherwise(0)).alias("end_seq"))
    return ep.stale_jobs(jobs, spans).select("conversation_id", "start_seq", "end_seq", "current")


def token_budget_tail(spark, sf_dir) -> DataFrame:
    """The newest turns whose estimated tokens fit 300, newest first until the first that doesn't."""
    rows = ad.msg_conv(spark, sf_dir).select("conversation_id", "seq", token_estimate(F.col("content")).alias("tokens"))
    last = rows.groupBy("conversation_id").agg(F.max("seq").alias("last"))
    newest = rows.join(last, "conversation_id").withColumn("back", F.col("last") - F.col("seq"))
    return running_sum(newest, "conversation_id", "back", F.col("tokens"), "used").filter("used <= 300").select("conversation_id", "seq", "used")


def _insertions() -> list:
    first, second = F.split("content", " ")[0], F.split("content", " ")[1]
    return [(first, F.lit("week of 5 May")), (second, F.lit("(2024)")), (F.concat_ws(" ", first, second), F.lit(" 2024-05-05 ")), (second, F.lit("soon"))]


def anchor_validate(spark, sf_dir) -> DataFrame:
    checks = [valid_anchor(F.col("content"), e, a).alias(f"v{i}") for i, (e, a) in enumerate(_insertions())]
    return ad.msg_conv(spark, sf_dir).select("conversation_id", "seq", *checks)


def anchor_apply(spark, sf_dir) -> DataFrame:
    listed = F.array(*[F.struct(e.alias("exact"), a.alias("anchor")) for e, a in _insertions()[:3:2]])
    return ad.msg_conv(spark, sf_dir).select("conversation_id", "seq", apply_anchors(F.col("content"), listed).alias("anchored"))


#: Pieces in which a log arrives; after each the stream stops, and starts again from its checkpoint.
PIECES = 4


def _log(messages: DataFrame) -> DataFrame:
    """The stream's rows of a log, by piece; the last piece also has each conversation's end."""
    log = messages.select("conversation_id", "seq", F.unix_micros("ts").alias("us"), F.length("content").cast("long").alias("n_chars"), F.lit(False).alias("eof"))
    width = log.groupBy("conversation_id").agg(F.ceil((F.max("seq") + 1) / PIECES).alias("width"))
    ends = width.select("conversation_id", *[F.lit(None).cast("long").alias(c) for c in ("seq", "us", "n_chars")], F.lit(True).alias("eof"), F.lit(PIECES - 1).alias("piece"))
    return log.join(width, "conversation_id").withColumn("piece", F.floor(F.col("seq") / F.col("width")).cast("int")).drop("width").unionByName(ends)


def _streamed(spark, messages: DataFrame) -> str:
    """The folder of the spans that the live segmentation makes of a log."""
    ship(spark)
    folder = f"{scratch_folder(spark)}/stream"
    log = stored(_log(messages))
    for piece in range(PIECES):
        log.filter(F.col("piece") == piece).drop("piece").write.mode("append").parquet(f"{folder}/in")
        spans = stream_spans(spark.readStream.schema("conversation_id string, seq long, us long, n_chars long, eof boolean").parquet(f"{folder}/in"))
        spans.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def stream_segments(spark, sf_dir) -> DataFrame:
    """The log as a stream that comes in pieces, with a restart between them: all spans, once each."""
    return spark.read.schema(OUTPUT).parquet(_streamed(spark, ad.msg_dense(spark, sf_dir)))


def stream_episodes(spark, sf_dir) -> DataFrame:
    """The second stage: batches of new spans become episodes. The last batch is run twice, as after a crash before its commit, and doubles nothing."""
    messages = ad.msg_conv(spark, sf_dir)
    spans, folder = _streamed(spark, messages), f"{scratch_folder(spark)}/episodes"

    def run() -> None:
        stream = spark.readStream.schema(OUTPUT).option("maxFilesPerTrigger", 64).parquet(spans)
        episode_stage(stream, messages, f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    forget_last_commit(spark, f"{folder}/state")
    run()
    return read_batches(spark, f"{folder}/out").select(
        "id", "conversation_id", "start_seq", "end_seq", "classification", "title", F.size("messages").cast("long").alias("n"), F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"),
        F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"),
    )


def stream_sessions(spark, sf_dir) -> DataFrame:
    """Sessions of a log that arrives in four pieces by time, every 97th message with the last piece only: those that come over two hours behind are counted apart."""
    folder = f"{scratch_folder(spark)}/sessions"
    rows = ad.msg_hard(spark, sf_dir).select("conversation_id", "seq", "ts")
    span = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("z"))
    piece = F.when(F.col("seq") % 97 == 5, PIECES - 1).otherwise(F.floor((F.unix_micros("ts") - F.col("a")) * PIECES / (F.col("z") - F.col("a") + 1)))
    log = stored(rows.crossJoin(F.broadcast(span)).select("conversation_id", "seq", "ts", piece.cast("int").alias("piece")))  # span: one row
    kinds = "conversation_id string, seq long, ts timestamp"
    # At last a message of no conversation, a day after all others, lets the watermark pass the last sessions.
    end = log.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("string").alias("conversation_id"), F.lit(None).cast("long").alias("seq"), "ts")
    for i in range(PIECES + 1):
        part = log.filter(F.col("piece") == i).drop("piece") if i < PIECES else end
        part.write.mode("append").parquet(f"{folder}/in")
        gate(spark.readStream.schema(kinds).parquet(f"{folder}/in"), "2 HOURS", f"{folder}/gate").option("checkpointLocation", f"{folder}/gate_state").trigger(availableNow=True).start().awaitTermination()
        timely = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(f"{folder}/gate/timely")
        made = sessions(timely, "30 minutes", "2 hours").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        made.trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.schema("conversation_id string, n long, start_seq long, end_seq long").parquet(f"{folder}/out").filter("conversation_id IS NOT NULL")
    late = spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{folder}/gate/late")
    late = late.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))
    return whole.select(F.lit("session").alias("kind"), "*").unionByName(late.select(F.lit("late").alias("kind"), "*"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_segments, stream_episodes, stream_sessions, range_scan_messages, seq_assignment, adjacent_gaps, temporal_boundaries, bucket_ranges, primitive_review, split_ranges, merge_groups, merge_sweep, commit_plan, commit_plan_eof, claim_trigger,
        stale_leases, processing_status, legacy_time_gap, session_window_gap, episode_materialize, render_transcript, prompt_lines, uuid5_ids, stale_jobs, token_budget_tail, anchor_validate, anchor_apply,
    )
}

_SPANS_SQL = """SELECT m.*, f.start_seq, f.end_seq, f.classification FROM msg_conv m JOIN final f ON f.conversation_id = m.conversation_id AND m.seq BETWEEN f.start_seq AND f.end_seq"""
_UUID_SQL = "sha1(from_hex('" + EPISODE_NAMESPACE.hex + "') || encode({name}))"


def _uuid_of(h: str) -> str:
    return f"left({h}, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || ['8','9','a','b'][1 + (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4] || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_TOKENS = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_UTC = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_COLLAPSED = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"

_EPISODES_SQL = sql(
    f"""SELECT {_uuid_of('h')} AS id, conversation_id, start_seq, end_seq, classification, array_to_string({_TOKENS.format(text='words')}[1:12], ' ') AS title, n, start_us, end_us, CAST(2.3065 AS DOUBLE) AS stability, CAST(2.118104 AS DOUBLE) AS difficulty
        FROM (SELECT *, {_UUID_SQL.format(name="conversation_id || ':' || start_seq")} AS h FROM (SELECT conversation_id, start_seq, end_seq, classification, count(*) AS n, string_agg(content, ' ' ORDER BY seq) AS words,
        epoch_us(arg_min(ts, seq)) AS start_us, epoch_us(arg_max(ts, seq)) AS end_us FROM placed GROUP BY 1, 2, 3, 4))""",
        "msg_conv", recursive=True, **_chain("msg_conv", "final"), placed=_SPANS_SQL,
)

ORACLE_SQL = {
    "stream_episodes": _EPISODES_SQL,
    "stream_sessions": sql(
        """SELECT 'session' AS kind, conversation_id, count(*) AS n, min(seq) AS start_seq, max(seq) AS end_seq FROM (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ts, seq) AS run FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY conversation_id ORDER BY ts, seq) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM placed WHERE NOT late)) GROUP BY conversation_id, run
        UNION ALL SELECT 'late', conversation_id, count(*), min(seq), max(seq) FROM placed WHERE late GROUP BY conversation_id""", "msg_hard",
        held="""SELECT *, CASE WHEN seq % 97 = 5 THEN 3 ELSE CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 4 / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) AS INTEGER) END AS piece FROM msg_hard""",
        placed="SELECT *, piece = 3 AND ts <= (SELECT max(ts) FROM held WHERE piece < 3) - INTERVAL 2 HOUR AS late FROM held",
    ),
    "range_scan_messages": sql("SELECT conversation_id, seq, role, content FROM msg_dense WHERE seq BETWEEN 10 AND 29", "msg_dense"),
    "seq_assignment": sql("SELECT conversation_id, seq + 1000 AS seq, epoch_us(ts) AS us FROM msg_dense", "msg_dense"),
    "adjacent_gaps": sql("SELECT conversation_id, seq, gap_us, gap_minutes, boundary FROM typed", "msg_hard", **_chain("msg_hard", "typed")),
    "temporal_boundaries": sql("SELECT conversation_id, seq - 1 AS left_end_seq, seq AS right_start_seq, boundary, gap_minutes FROM typed WHERE boundary <> 'none'", "msg_conv", **_chain("msg_conv", "typed")),
    "bucket_ranges": sql("SELECT conversation_id, CAST(bucket AS BIGINT) AS bucket, start_seq, end_seq, n, CAST(n_chars AS BIGINT) AS n_chars, boundary, gap_minutes FROM buckets", "msg_dense", **_chain("msg_dense", "buckets")),
    "primitive_review": sql("SELECT * FROM segments", "msg_dense", **_chain("msg_dense", "segments")),
    "split_ranges": sql(
        """SELECT conversation_id, start_seq + s AS first_seq, start_seq + coalesce(lead(s) OVER (PARTITION BY conversation_id, start_seq ORDER BY s), n) - 1 AS last_seq FROM (
        SELECT conversation_id, start_seq, n, unnest(list_distinct(list_filter([n + 5, 3, 0, 3, 1, n // 2], lambda i: i >= 0 AND i < n))) AS s FROM buckets WHERE n > 4)""",
        "msg_dense", **_chain("msg_dense", "buckets"),
    ),
    "merge_groups": sql("SELECT conversation_id, start_seq, end_seq, group_start FROM fold", "msg_dense", recursive=True, **_chain("msg_dense", "fold")),
    "stream_segments": sql("SELECT * FROM final", "msg_dense", recursive=True, **_chain("msg_dense", "final")),
    "merge_sweep": sql("SELECT * FROM final", "msg_dense", recursive=True, **_chain("msg_dense", "final")),
    "commit_plan": sql(
        "SELECT *, start_seq < max(start_seq) OVER (PARTITION BY conversation_id) AS finalized, max(start_seq) OVER (PARTITION BY conversation_id) AS next_seq FROM final",
        "msg_dense", recursive=True, **_chain("msg_dense", "final"),
    ),
    "commit_plan_eof": sql("SELECT *, true AS finalized, max(end_seq) OVER (PARTITION BY conversation_id) + 1 AS next_seq FROM final", "msg_hard", recursive=True, **_chain("msg_hard", "final")),
    "claim_trigger": sql(
        """SELECT conversation_id, pending, has_gap, last_message_seq >= next_segment_start_seq AND active_segment_start_seq IS NULL AND (eof_identified OR pending >= 20 OR has_gap) AS due
        FROM (SELECT s.*, greatest(0, s.last_message_seq - s.next_segment_start_seq + 1) AS pending,
        EXISTS (SELECT 1 FROM typed t WHERE t.conversation_id = s.conversation_id AND t.seq > s.next_segment_start_seq AND t.seq <= s.last_message_seq AND t.gap_us >= 1800000000) AS has_gap FROM states s)""",
        "states", **_chain("msg_user", "typed"),
    ),
    "stale_leases": sql(
        f"SELECT conversation_id, active_segment_start_seq AS next_segment_start_seq, last_message_seq FROM states WHERE active_segment_start_seq IS NOT NULL AND active_since < TIMESTAMP '{ad.NOW}' - INTERVAL 120 MINUTE", "states"
    ),
    "processing_status": sql(
        """SELECT conversation_id, greatest(0, last_message_seq - next_segment_start_seq + 1) AS pending, active_segment_start_seq IS NOT NULL AS active,
        active_segment_start_seq IS NULL AND greatest(0, last_message_seq - next_segment_start_seq + 1) = 0 AS done FROM states""", "states"
    ),
    "legacy_time_gap": sql(
        """SELECT conversation_id, segment, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n, CASE WHEN segment > 0 THEN 'time_gap' ELSE 'start' END AS reason FROM (
        SELECT *, CAST(sum(CASE WHEN gap_us > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY seq) AS BIGINT) AS segment FROM typed) GROUP BY conversation_id, segment""",
        "msg_hard", **_chain("msg_hard", "typed"),
    ),
    "session_window_gap": sql(
        """SELECT conversation_id, count(*) AS n, min(seq) AS start_seq, max(seq) AS end_seq FROM (
        SELECT *, sum(CASE WHEN gap_us > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY seq) AS segment FROM typed) GROUP BY conversation_id, segment""",
        "msg_hard", **_chain("msg_hard", "typed"),
    ),
    "episode_materialize": _EPISODES_SQL,
    "render_transcript": sql(
        f"""SELECT conversation_id, start_seq, regexp_replace(string_agg(piece, '' ORDER BY seq), '\\s+$', '') AS content FROM (SELECT *, CASE WHEN before IS NULL THEN header || chr(10) WHEN before <> hour THEN chr(10) || chr(10) || header || chr(10) ELSE chr(10) END || role || ': ' || {_COLLAPSED} AS piece
        FROM (SELECT *, date_trunc('hour', ts) AS hour, lag(date_trunc('hour', ts)) OVER (PARTITION BY conversation_id, start_seq ORDER BY seq) AS before, 'Spoken At: ' || strftime(ts, '%b %-d, %Y %-I %p') AS header FROM placed)) GROUP BY 1, 2""",
        "msg_conv", recursive=True, **_chain("msg_conv", "final"), placed=_SPANS_SQL,
    ),
    "prompt_lines": sql(
        f"""SELECT conversation_id, start_seq, string_agg('Message ' || (i + 1) || ' [' || {_UTC} || '] ' || role || ': ' || content, chr(10) ORDER BY seq) AS numbered,
        string_agg('- [idx=' || i || '] ' || {_UTC} || ' [' || role || '] ' || content, chr(10) ORDER BY seq) AS indexed FROM (SELECT *, seq - start_seq AS i FROM placed) GROUP BY 1, 2""",
        "msg_conv", recursive=True, **_chain("msg_conv", "final"), placed=_SPANS_SQL,
    ),
    "uuid5_ids": sql(
        f"SELECT conversation_id, start_seq, {_uuid_of('h')} AS id FROM (SELECT conversation_id, start_seq, {_UUID_SQL.format(name="conversation_id || ':' || start_seq")} AS h FROM buckets)", "msg_dense", **_chain("msg_dense", "buckets")
    ),
    "stale_jobs": sql(
        """SELECT j.conversation_id, j.start_seq, j.end_seq, coalesce(s.end_seq = j.end_seq, false) AS current FROM (SELECT conversation_id, start_seq + CASE WHEN start_seq % 7 = 0 THEN 1 ELSE 0 END AS start_seq,
        end_seq + CASE WHEN end_seq % 5 = 0 THEN 1 ELSE 0 END AS end_seq FROM buckets) j LEFT JOIN buckets s ON s.conversation_id = j.conversation_id AND s.start_seq = j.start_seq""",
        "msg_dense", **_chain("msg_dense", "buckets"),
    ),
    "token_budget_tail": sql(
        """SELECT conversation_id, seq, CAST(used AS BIGINT) AS used FROM (SELECT conversation_id, seq, sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS used FROM msg_conv) WHERE used <= 300""", "msg_conv"
    ),
    "anchor_validate": sql(
        """SELECT conversation_id, seq, w[1] <> '' AND lower(w[1]) <> 'week of 5 may' AS v0, false AS v1, coalesce(trim(w[1] || ' ' || w[2]) <> '', trim(w[1]) <> '') AS v2, false AS v3
        FROM (SELECT *, string_split(content, ' ') AS w FROM msg_conv)""", "msg_conv"
    ),
    # Of the two insertions the longer text is first; the shorter one then stands before its bracket only if it is the same text.
    "anchor_apply": sql(
        f"""SELECT conversation_id, seq, CASE WHEN w[1] = '' OR strpos(once, w[1] || ' (') > 0 OR (length(once) - length(replace(once, w[1], ''))) / length(w[1]) <> 1 THEN once ELSE replace(once, w[1], w[1] || ' (week of 5 May)') END AS anchored
        FROM (SELECT *, CASE WHEN e = '' OR strpos(content, e || ' (') > 0 OR (length(content) - length(replace(content, e, ''))) / length(e) <> 1 THEN content ELSE replace(content, e, e || ' (2024-05-05)') END AS once
        FROM (SELECT *, string_split(content, ' ') AS w, concat_ws(' ', string_split(content, ' ')[1], string_split(content, ' ')[2]) AS e FROM msg_conv))""", "msg_conv"
    ),
}

"""Queries on readers and on text: datasets and vector caches written as their files and read again, and the lines and labels shown to people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palim.functions import events, text
from palim.operators import consolidation, episodes, retrieval
from palim.operators import segmentation as seg
from palim.plans.retrieving import _facts, _semantic
from palim.schemas import QUESTION_TYPES
from palim.sources import adapters as ad
from palim.sources import datasets as ds
from palim.sources.adapters import NOW, sql
from palim.sources.json_array import write_json_arrays
from palim.sources.store import scratch_folder

_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _json_files(spark, rows: DataFrame) -> str:
    """JSON texts in rows (column `json`) as files of arrays, one for each partition."""
    path = scratch_folder(spark)
    write_json_arrays(rows, "json", path)
    return path


# Dialogues: ten conversations in a row are the sessions of a sample; sample 3 lacks its fourth one, so that its sessions end there.


def _dialogue_file(spark, sf_dir) -> DataFrame:
    rows = ad.table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") % 10 + 1).withColumn("sample_id", F.floor(F.col("conv_id") / 10).cast("string"))
    turn = F.struct(
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("role")).alias("speaker"), F.concat_ws(":", "conv_id", "turn").alias("dia_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" photo of "), "role")).alias("blip_caption"), F.when(F.col("turn") % 8 == 1, "garden").alias("search_query"), F.when(F.col("turn") % 8 == 5, " tea ").alias("query"),
    )
    held = rows.filter("sample_id <> '3' OR n <> 4").groupBy("sample_id", "n", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("turns"))
    date = F.concat((F.col("conv_id") % 12 + 1).cast("string"), F.lit(":"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0"), _pick((" am", " pm"), F.col("conv_id") % 2), F.lit(" on "), (F.col("conv_id") % 28 + 1).cast("string"), F.lit(" "), _pick(_MONTHS, F.col("conv_id") % 12), F.lit(", 2023"))
    entry = F.concat(F.lit('"session_'), F.col("n").cast("string"), F.lit('":'), F.to_json(F.transform("turns", lambda t: t["t"])), F.lit(',"session_'), F.col("n").cast("string"), F.lit('_date_time":"'), date, F.lit('"'))
    asked = ad.qa(spark, sf_dir).withColumn("sample_id", F.floor(F.col("conv_id") / 10).cast("string")).select(
        "sample_id",
        F.struct(
            "conv_id", "turn", F.struct(F.concat(F.lit("why "), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("question"), F.when((F.col("category") < 5) | (F.col("turn") % 4 == 0), F.col("gold")).alias("answer"), F.lit("not said").alias("adversarial_answer"), "category").alias("q")
        ).alias("x"),
    )
    qa = asked.groupBy("sample_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"])).alias("qa"))
    samples = held.select("sample_id", entry.alias("entry")).groupBy("sample_id").agg(F.array_join(F.collect_list("entry"), ",").alias("c")).join(qa, "sample_id", "left")
    json = F.concat(F.lit('{"sample_id":"'), "sample_id", F.lit('","conversation":{"speaker_a":"user",'), "c", F.lit('},"qa":'), F.coalesce("qa", F.lit("[]")), F.lit("}"))
    return ds.dialogues(spark, _json_files(spark, samples.select(json.alias("json"))))


def dialogue_questions(spark, sf_dir) -> DataFrame:
    """Questions with their answers; of category 5, the adversarial one stands in for a missing one."""
    return ds.questions(_dialogue_file(spark, sf_dir)).select("sample_id", F.col("place").cast("long").alias("place"), "question", "answer", "category")


def dialogue_sessions(spark, sf_dir) -> DataFrame:
    """Sessions up to the first that is missing, with their dates."""
    return ds.sessions(_dialogue_file(spark, sf_dir)).select("sample_id", F.col("n").cast("long").alias("n"), "date_text", F.unix_micros("date").alias("date_us"), F.size("turns").cast("long").alias("n_turns"))


def dialogue_messages(spark, sf_dir) -> DataFrame:
    rows = ds.dialogue_messages(_dialogue_file(spark, sf_dir))
    return rows.select("sample_id", F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "content", F.unix_micros("ts").alias("us"))


def full_context(spark, sf_dir) -> DataFrame:
    return ds.full_context(_dialogue_file(spark, sf_dir))


def haystack_messages(spark, sf_dir) -> DataFrame:
    """Conversations as haystacks: sessions of four turns beside an array of dates."""
    rows = ad.table(spark, sf_dir, "conversations").withColumn("s", F.floor(F.col("turn") / 4))
    said = F.struct("role", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, " ").otherwise(F.col("text")).alias("content"), (F.col("turn") == 1).alias("has_answer"))
    sessions = rows.groupBy("conv_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("m")))), lambda t: t["m"]).alias("turns"))
    date = F.concat(F.lit("2023/05/"), F.lpad((F.col("s") % 28 + 1).cast("string"), 2, "0"), F.lit(" (Mon) 0"), (F.col("conv_id") % 10).cast("string"), F.lit(":30"))
    grouped = sessions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", date.alias("date"), "turns"))).alias("x"))
    json = F.to_json(
        F.struct(
            F.col("conv_id").cast("string").alias("question_id"), _pick(QUESTION_TYPES, F.col("conv_id") % 6).alias("question_type"), F.lit("why").alias("question"), F.lit("so").alias("answer"),
            F.transform("x", lambda v: v["date"]).alias("haystack_dates"), F.transform("x", lambda v: v["turns"]).alias("haystack_sessions"),
        )
    )
    path = _json_files(spark, grouped.select(json.alias("json")))
    out = ds.haystack_messages(ds.haystacks(spark, path))
    return out.select("question_id", F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "content", F.unix_micros("ts").alias("us"))


def vector_cache(spark, sf_dir) -> DataFrame:
    """A cache with blank lines and repeated keys, as it is read."""
    path = scratch_folder(spark)
    rows = ad.table(spark, sf_dir, "embeddings").withColumn("key", F.concat(F.lit("k"), (F.col("vec_id") % 50).cast("string")))
    line = F.concat(F.to_json(F.struct("key", "embedding")), F.when(F.col("vec_id") % 9 == 0, "\n").otherwise(""))
    rows.select("vec_id", line.alias("value")).repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("value").write.text(path)  # files in the order of their rows
    out = ds.read_cache(spark, path)
    return out.select("key", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def cache_append(spark, sf_dir) -> DataFrame:
    """A cache that grows twice; of a key's vectors the one added last holds."""
    path = scratch_folder(spark)
    rows = ad.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("k"), (F.col("vec_id") % 40 + F.col("vec_id") % 2 * 20).cast("string")).alias("key"), "embedding", "vec_id")
    last = Window.partitionBy("key").orderBy(F.desc("vec_id"))
    for part in ("vec_id % 3 = 0", "vec_id % 3 > 0"):
        ds.append_cache(rows.filter(part).withColumn("n", F.row_number().over(last)).filter("n = 1"), path)
    return ds.read_cache(spark, path).select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def legacy_plan(spark, sf_dir) -> DataFrame:
    """Proposed starts to contiguous ranges."""
    item = F.struct("event_id", (F.col("user_id") % 9 - 1).alias("start"), _pick(("low", "high", "extremely_high"), F.col("event_id") % 3).alias("surprise"))
    rows = ad.table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 5).alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.transform("items", lambda x: F.struct(x["start"].alias("start"), x["surprise"].alias("surprise")))
    ranges = rows.select("g", F.explode(seg.resolve_plan(F.col("g") % 7 + 1, items)).alias("r"))
    return ranges.select("g", "r.first", "r.last", "r.surprise", text.surprise_value(F.col("r.surprise")).alias("value"))


# Lines and labels.


def event_lines(spark, sf_dir) -> DataFrame:
    """Events as tagged JSON, read again: messages only, as lines with and without their time."""
    role = _pick(("USER", "Assistant", "Narrator"), F.col("user_id") % 3)
    tagged = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.lit("image").alias("type"), F.lit("x").alias("url")))).otherwise(events.encode(role, F.col("props")))
    rows = events.messages(ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), tagged.alias("event")))
    return rows.select("event_id", "role", events.text().alias("line"), events.text(F.col("ts")).alias("dated"))


def labels(spark, sf_dir) -> DataFrame:
    """Durations, ages, percentages and short questions, as they are shown."""
    k = F.col("event_id")
    seconds = (k * k * 37) % 40_000_000
    share = (k % 201 - 100) / 1000
    return ad.table(spark, sf_dir, "events").select(
        "event_id", text.narrow_duration(seconds % 200_000).alias("duration"), text.human_age(seconds).alias("age"), text.percent(share).alias("share"), text.signed_percent(share).alias("change"),
        text.shortened(F.concat_ws(" ", "event_type", F.repeat("props", (k % 5 + 1).cast("int")))).alias("short"), F.unix_micros(F.timestamp_millis(k * 86_400_123)).alias("us"),
    )


def titles(spark, sf_dir) -> DataFrame:
    """A template with the title of each memory, blank ones replaced."""
    title = text.title_or_default(F.when(F.col("id") % 7 == 0, "  ").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "title")))
    return ad.episodic(spark, sf_dir).select("id", text.fill_template(F.lit("{title} ({id}, {id}) {other}"), {"title": title, "id": F.col("id").cast("string"), "other": F.lit(None).cast("string")}).alias("line"))


def _per_conversation(spark, sf_dir) -> DataFrame:
    rows = ad.episodic(spark, sf_dir)
    return rows.withColumn("age", text.human_age(F.greatest(F.lit(0).cast("long"), F.unix_seconds(ad.now()) - F.unix_seconds("created_at"))))


def memories_markdown(spark, sf_dir) -> DataFrame:
    """What a retrieval shows for each conversation: its episodes (here: titles) and facts; some have no facts, some no episodes."""
    rows = _per_conversation(spark, sf_dir)
    shown = rows.groupBy("conversation_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("conversation_id") != "3", F.struct("id", "title")))), lambda x: x["title"]).alias("contents"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("conversation_id") != "4", F.struct("id", "classification")))), lambda x: x["classification"]).alias("facts"),
    )
    return shown.select("conversation_id", text.memories_markdown(F.col("contents"), F.col("facts")).alias("markdown"))


def recent_entries(spark, sf_dir) -> DataFrame:
    rows = _per_conversation(spark, sf_dir)
    return rows.select("id", text.recent_entry(F.when(F.col("id") % 10 == 0, "").otherwise(F.col("title")), F.col("surprise"), F.col("age"), F.col("content")).alias("entry"))


def consolidation_branch(spark, sf_dir) -> DataFrame:
    """For each query the related facts (20 at most), and the way on: none, a cold start; else a prediction from 10 at most and a calibration with all."""
    facts, asked = _facts(spark, sf_dir)
    asked = asked.unionByName(asked.select(F.concat(F.lit("new "), "query_id").alias("query_id"), F.lit("nobody").alias("conversation_id"), "text", "embedding"))
    found = retrieval.semantic(facts, asked, 20).join(facts.select("id", "category"), "id")
    predicted = consolidation.pick_for_prediction(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_predict"))
    both = asked.select("query_id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_related")), "query_id", "left").join(predicted, "query_id", "left")
    return both.select("query_id", F.coalesce("n_related", F.lit(0)).alias("n_related"), F.coalesce("n_predict", F.lit(0)).alias("n_predict"), F.when(F.col("n_related").isNull(), "cold_start").otherwise("calibrate").alias("branch"))


def fact_valid_at(spark, sf_dir) -> DataFrame:
    """When a fact of an episode is valid from: the later of the episode's ends."""
    return ad.episodic(spark, sf_dir).select("id", F.unix_micros(episodes.valid_at(F.col("created_at"), F.col("last_reviewed_at"))).alias("us"))


def commit_checks(spark, sf_dir) -> DataFrame:
    """Claims beside the leases they are to commit: whether the lease is the claim's and the next segment starts in it or right behind."""
    state = ad.states(spark, sf_dir)
    k = F.col("conversation_id").cast("long")
    claims = state.select("conversation_id", F.col("next_segment_start_seq").alias("claim_start"), (F.col("last_message_seq") + F.when(k % 5 == 0, 1).otherwise(0)).alias("claim_end"), (F.col("last_message_seq") + k % 4 - 1).alias("next"))
    return seg.checked_claims(state, claims).select("conversation_id", "problem")


QUERIES = {
    f.__name__: f
    for f in (
        dialogue_questions, dialogue_sessions, dialogue_messages, full_context, haystack_messages, vector_cache, cache_append, legacy_plan, event_lines, labels, titles, memories_markdown, recent_entries, consolidation_branch, fact_valid_at, commit_checks,
    )
}

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in _MONTHS) + "]"
_TALK = """SELECT *, CAST(conv_id // 10 AS VARCHAR) AS sample_id, conv_id % 10 + 1 AS n, CASE WHEN turn % 5 = 4 THEN '  ' ELSE role END AS speaker, CASE WHEN (conv_id + turn) % 6 = 0 THEN '  ' ELSE ' ' || text || ' ' END AS said,
    CASE WHEN turn % 4 = 1 THEN ' photo of ' || role END AS caption, CASE WHEN turn % 8 = 1 THEN 'garden' END AS search_query, CASE WHEN turn % 8 = 5 THEN ' tea ' END AS query FROM conversations"""
#: Sessions before the first that is missing.
_KEPT = "SELECT * FROM talk t WHERE n <= 100 AND (sample_id <> '3' OR n < 4) AND n <= (SELECT max(m) FROM (SELECT n AS m, row_number() OVER (ORDER BY n) AS r FROM (SELECT DISTINCT n FROM talk u WHERE u.sample_id = t.sample_id)) WHERE m = r)"
_DATED = f"""SELECT sample_id, n, conv_id, count(*) AS n_turns, make_timestamp(2023, conv_id % 12 + 1, conv_id % 28 + 1, (conv_id % 12 + 1) % 12 + CASE WHEN conv_id % 2 = 1 THEN 12 ELSE 0 END, conv_id % 60, 0.0) AS date,
    (conv_id % 12 + 1) || ':' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') || CASE WHEN conv_id % 2 = 1 THEN ' pm' ELSE ' am' END || ' on ' || (conv_id % 28 + 1) || ' ' || {_MONTH_LIST}[1 + conv_id % 12] || ', 2023' AS date_text FROM kept GROUP BY 1, 2, 3"""
_D = {"talk": _TALK, "kept": _KEPT, "dated": _DATED}
_AGE = "CASE " + " ".join(
    f"WHEN {{s}} >= {size} THEN ({{s}} // {size}) || ' {name}' || CASE WHEN {{s}} // {size} > 1 THEN 's' ELSE '' END || ' ago'"
    for size, name in ((365 * 86400, "year"), (30 * 86400, "month"), (7 * 86400, "week"), (86400, "day"), (3600, "hour"), (60, "minute"), (1, "second"))
) + " ELSE 'now' END"
_SECONDS = "(event_id * event_id * 37) % 40000000"
_AGED = f"SELECT *, {_AGE.format(s='greatest(0, seconds)')} AS age FROM (SELECT *, CAST(epoch(TIMESTAMP '{NOW}') - epoch(created_at) AS BIGINT) AS seconds FROM episodic)"

ORACLE_SQL = {
    "dialogue_questions": sql(
        """SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY conv_id, turn) - 1 AS place, 'why ' || conv_id || ':' || turn AS question, CASE WHEN category < 5 OR turn % 4 = 0 THEN gold ELSE 'not said' END AS answer, category
        FROM (SELECT * REPLACE (CAST(conv_id // 10 AS VARCHAR) AS sample_id) FROM qa)""", "qa"
    ),
    "dialogue_sessions": sql("SELECT sample_id, n, date_text, epoch_us(date) AS date_us, n_turns FROM dated", **_D),
    "dialogue_messages": sql(
        """SELECT sample_id, n AS session, turn, CASE WHEN trim(speaker) = '' THEN 'User' ELSE trim(speaker) END AS role, trim(said) || CASE WHEN caption IS NULL THEN '' ELSE ' [Image: ' || trim(caption) ||
        CASE WHEN coalesce(query, search_query) IS NULL THEN '' ELSE '; Image Retrieval Keywords: ' || trim(coalesce(query, search_query)) END || ']' END AS content, epoch_us(date) + turn * 60000000 AS us FROM kept JOIN dated USING (sample_id, n, conv_id) WHERE trim(said) <> ''""", **_D
    ),
    "full_context": sql(
        """SELECT sample_id, 'Below is a conversation between two people over multiple days.' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY n) AS context FROM (
        SELECT sample_id, n, rtrim('DATE: ' || any_value(date_text) || chr(10) || 'CONVERSATION:' || chr(10) || string_agg(speaker || ' said, "' || said || '"' || CASE WHEN caption IS NULL THEN '' ELSE chr(10) || 'and shared ' || caption || '.' END ||
        CASE WHEN search_query IS NULL THEN '' ELSE chr(10) || 'Search query: ' || search_query || '.' END, chr(10) ORDER BY turn), ' ') AS body FROM kept JOIN dated USING (sample_id, n, conv_id) GROUP BY 1, 2) GROUP BY 1""", **_D
    ),
    "haystack_messages": """SELECT CAST(conv_id AS VARCHAR) AS question_id, turn // 4 AS session, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS turn, role, text AS content,
        epoch_us(make_timestamp(2023, 5, CAST((turn // 4) % 28 + 1 AS BIGINT), conv_id % 10, 30, 0.0)) + (row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1) * 60000000 AS us FROM conversations QUALIFY (conv_id + conversations.turn) % 7 <> 0 AND trim(text) <> ''""",
    "vector_cache": "SELECT key, CAST(len(e) AS BIGINT) AS n, round(list_sum(CAST(e AS DOUBLE[])), 5) AS total FROM (SELECT 'k' || (vec_id % 50) AS key, arg_max(embedding, vec_id) AS e FROM embeddings GROUP BY 1)",
    "cache_append": """SELECT key, round(list_sum(CAST(e AS DOUBLE[])), 5) AS total FROM (SELECT 'k' || (vec_id % 40 + vec_id % 2 * 20) AS key, coalesce(arg_max(embedding, vec_id) FILTER (WHERE vec_id % 3 > 0), arg_max(embedding, vec_id)) AS e FROM embeddings GROUP BY 1)""",
    "legacy_plan": """WITH items AS (SELECT event_id // 5 AS g, (event_id // 5) % 7 + 1 AS n, event_id, user_id % 9 - 1 AS start, ['low', 'high', 'extremely_high'][1 + event_id % 3] AS surprise FROM events),
        starts AS (SELECT g, n, start, arg_min(surprise, event_id) AS surprise FROM items WHERE start BETWEEN 0 AND n - 1 GROUP BY 1, 2, 3),
        whole AS (SELECT * FROM starts UNION ALL SELECT DISTINCT g, n, 0, 'low' FROM items i WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.g = i.g AND s.start = 0))
        SELECT g, start AS first, coalesce(lead(start) OVER (PARTITION BY g ORDER BY start), n) - 1 AS last, surprise, CAST(CASE surprise WHEN 'low' THEN 0.2 WHEN 'high' THEN 0.6 ELSE 0.9 END AS DOUBLE) AS value FROM whole""",
    "event_lines": """SELECT event_id, role, role || ': ' || props AS line, '[' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || '] ' || role || ': ' || props AS dated
        FROM (SELECT *, ['user', 'assistant', 'Narrator'][1 + user_id % 3] AS role FROM events WHERE event_id % 5 <> 0)""",
    "labels": f"""SELECT event_id, CASE WHEN h + m = 0 THEN (d % 60) || 's' ELSE concat_ws(' ', CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END) END AS duration, {_AGE.format(s='s')} AS age,
        printf('%.2f%%', share * 100) AS share, CASE WHEN share >= 0 THEN '+' ELSE '' END || printf('%.2f%%', share * 100) AS change,
        CASE WHEN length(q) > 80 THEN left(q, 79) || '…' ELSE q END AS short, event_id * 86400123 * 1000 AS us
        FROM (SELECT *, d // 3600 AS h, (d % 3600) // 60 AS m FROM (SELECT event_id, {_SECONDS} AS s, ({_SECONDS}) % 200000 AS d, (event_id % 201 - 100) / 1000.0 AS share, event_type || ' ' || repeat(props, event_id % 5 + 1) AS q FROM events))""",
    "titles": sql(
        """SELECT id, t || ' (' || id || ', ' || id || ') ' AS line FROM (SELECT id, CASE WHEN id % 7 <= 1 OR trim(regexp_replace(title, '\\s+', ' ', 'g')) = '' THEN 'Conversation Segment' ELSE trim(title) END AS t FROM episodic)""", "episodic"
    ),
    "memories_markdown": sql(
        """SELECT conversation_id, regexp_replace(CASE WHEN conversation_id = '3' THEN '' ELSE '## Episodic Memories' || chr(10) || string_agg(title || chr(10) || chr(10), '' ORDER BY id) END ||
        CASE WHEN conversation_id = '4' THEN '' ELSE '## Known Facts' || chr(10) || string_agg('- ' || classification, chr(10) ORDER BY id) END, '\\s+$', '') AS markdown FROM aged GROUP BY 1""", "episodic", aged=_AGED
    ),
    "recent_entries": sql(
        """SELECT id, '### ' || CASE WHEN id % 10 = 0 OR title = '' THEN 'Memory' ELSE title END || CASE WHEN surprise >= 0.7 THEN ' (key moment)' ELSE '' END || chr(10) || '**When:** ' || age || chr(10) || '**Content:** ' || content || chr(10) AS entry FROM aged""", "episodic", aged=_AGED
    ),
    "consolidation_branch": sql(
        """SELECT query_id, count(*) AS n_related, CAST(least(3, count(*) FILTER (WHERE g)) + least(10 - least(3, count(*) FILTER (WHERE g)), count(*) FILTER (WHERE NOT g)) AS BIGINT) AS n_predict, 'calibrate' AS branch
        FROM (SELECT query_id, category = 'guideline' AS g FROM found JOIN semantic USING (id)) GROUP BY 1 UNION ALL
        SELECT query_id, 0, 0, 'cold_start' FROM (SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM found) UNION ALL SELECT 'new ' || query_id FROM asked)""", "semantic", **_semantic()
    ),
    "fact_valid_at": sql("SELECT id, epoch_us(greatest(created_at, last_reviewed_at)) AS us FROM episodic", "episodic"),
    "commit_checks": sql(
        """SELECT conversation_id, CASE WHEN k % 3 <> 0 OR k % 5 = 0 THEN 'claim mismatch' WHEN next < next_segment_start_seq OR next > last_message_seq + 1 THEN 'next outside the claim' END AS problem
        FROM (SELECT *, last_message_seq + k % 4 - 1 AS next FROM states)""", "states"
    ),
}

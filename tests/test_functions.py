import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palim.functions import fsrs, text
from palim.functions.ids import EPISODE_NAMESPACE, episode_id
from palim.functions.vector import dot, normalize
from palim.operators import evaluation as ev


def value(spark, expr, **columns):
    row = spark.range(1).select(*[v.alias(k) for k, v in columns.items()])
    return row.select(expr.alias("v")).first()[0]


def test_hour_header(spark):
    for hour, shown in ((0, "12 AM"), (12, "12 PM"), (13, "1 PM")):
        ts = F.lit(datetime(2026, 6, 15, hour, 5))
        assert value(spark, text.hour_header(F.col("t")), t=ts) == f"Spoken At: Jun 15, 2026 {shown}"


def test_transcript_headers_follow_changes_of_the_hour(spark):
    times = [(10, 5), (10, 50), (11, 0), (10, 10)]
    rows = [(i, "Sam", f"  line\t {i}\n", datetime(2026, 6, 15, h, m)) for i, (h, m) in enumerate(times)]
    df = spark.createDataFrame([(rows,)], "m array<struct<seq:long,role:string,content:string,ts:timestamp>>")
    out = df.select(text.transcript(F.col("m"))).first()[0]
    assert out.count("Spoken At:") == 3
    assert out.startswith("Spoken At: Jun 15, 2026 10 AM\nSam: line 0\nSam: line 1\n\nSpoken At: Jun 15, 2026 11 AM\nSam: line 2\n\n")


@pytest.mark.parametrize(
    ("exact", "anchor", "content", "wanted"),
    [
        ("next week", "week of 5 May", "see you next week there", "see you next week (week of 5 May) there"),
        ("a", "5 May", "a and a", "a and a"),  # twice
        ("now", "5 May", "now (old) here", "now (old) here"),  # followed by a bracket
        ("now", "soon", "now here", "now here"),  # no digit
        ("now", "(5)", "now here", "now here"),  # brackets
        ("5  May", "5 may", "on 5  May", "on 5  May"),  # says the same
    ],
)
def test_anchors(spark, exact, anchor, content, wanted):
    df = spark.createDataFrame([(content, [(exact, anchor)])], "c string, i array<struct<exact:string,anchor:string>>")
    assert df.select(text.apply_anchors(F.col("c"), F.col("i"))).first()[0] == wanted


def test_longest_anchor_first(spark):
    df = spark.createDataFrame([("last summer trip", [("summer", "2022"), ("last summer", "June 2022")])], "c string, i array<struct<exact:string,anchor:string>>")
    assert df.select(text.apply_anchors(F.col("c"), F.col("i"))).first()[0] == "last summer (June 2022) trip"


@pytest.mark.parametrize(("raw", "score"), [("CORRECT", 1.0), (" partial ", 0.5), ("WRONG because", 0.0), ("CORRECT.", 0.0), (None, 0.0)])
def test_judge(spark, raw, score):
    assert value(spark, text.judge_label(F.col("x")), x=F.lit(raw).cast("string")) == score


@pytest.mark.parametrize(("raw", "rating"), [("AGAIN", "again"), ("hard", "hard"), ("x", "good"), (None, "good")])
def test_rating(spark, raw, rating):
    assert value(spark, text.parse_rating(F.col("x")), x=F.lit(raw).cast("string")) == rating


@pytest.mark.parametrize(("p", "g", "f1"), [("The cat and dog", "cat dog", 1.0), ("a a b", "a b b", 2 / 3), ("", "", 1.0), ("x", "", 0.0)])
def test_token_f1(spark, p, g, f1):
    assert value(spark, ev.token_f1(F.col("p"), F.col("g")), p=F.lit(p), g=F.lit(g)) == pytest.approx(f1)


def test_category_scores(spark):
    score = lambda c, p, g: value(spark, ev.category_score(F.col("c"), F.col("p"), F.col("g")), c=F.lit(c), p=F.lit(p), g=F.lit(g))
    assert score(1, "red blue", "red, green") == pytest.approx((2 / 3 + 0) / 2)
    assert score(3, "red", "red; green") == 1.0
    assert score(5, "It is Not Mentioned.", "red") == 1.0
    assert score(5, "red", "red") == 0.0


def test_embedding_rules(spark):
    make = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    assert value(spark, normalize(F.col("a"), 2), a=make([0.6, 0.8])) == [0.6, 0.8]
    assert value(spark, normalize(F.col("a"), 2), a=make([3, 4])) == pytest.approx([0.6, 0.8])
    assert value(spark, normalize(F.col("a"), 2), a=make([3, 4, 12])) == pytest.approx([0.6, 0.8])
    assert value(spark, normalize(F.col("a"), 2), a=make([0, 0])) == [0.0, 0.0]
    with pytest.raises(Exception, match="dimensions"):
        value(spark, normalize(F.col("a"), 2), a=make([1]))
    assert value(spark, dot(F.col("a"), F.col("b")), a=make([1, 2]), b=make([3])) == 0.0


def test_uuid5(spark):
    assert value(spark, episode_id(F.col("c"), F.col("s")), c=F.lit("conv"), s=F.lit(7)) == str(uuid.uuid5(EPISODE_NAMESPACE, "conv:7"))


def test_fsrs(spark):
    assert pytest.approx(2.1181, abs=1e-4) == fsrs.INITIAL_DIFFICULTY
    assert value(spark, fsrs.retrievability(F.col("s"), F.col("t")), s=F.lit(5.0), t=F.lit(5.0)) == pytest.approx(0.9)
    grow = lambda g: value(spark, fsrs.next_stability(F.col("s"), F.col("d"), F.col("t"), F.col("g")), s=F.lit(5.0), d=F.lit(5.0), t=F.lit(5.0), g=F.lit(g))
    again, hard, good, easy = map(grow, (1, 2, 3, 4))
    assert again < 5 < hard < good < easy


def test_small_helpers(spark):
    assert value(spark, text.narrow_duration(F.col("s")), s=F.lit(5400)) == "1h 30m"
    assert value(spark, text.narrow_duration(F.col("s")), s=F.lit(26 * 3600)) == "26h"
    assert value(spark, text.narrow_duration(F.col("s")), s=F.lit(42)) == "42s"
    assert value(spark, text.narrow_duration(F.col("s")), s=F.lit(0)) == "0s"
    assert value(spark, text.event_role(F.col("r")), r=F.lit("USER")) == "user"
    assert value(spark, text.event_role(F.col("r")), r=F.lit("system")) == "system"
    assert value(spark, text.fill_template(F.col("t"), {"a": F.lit("x")}), t=F.lit("{a}-{a}-{b}")) == "x-x-{b}"
    assert value(spark, text.surprise_value(F.col("l")), l=F.lit("high")) == 0.6
    assert value(spark, text.normalize_category(F.col("c")), c=F.lit("unknown")) == "identity"
    assert value(spark, text.normalize_category(F.col("c")), c=F.lit(" Guideline ")) == "guideline"
    assert value(spark, text.human_age(F.col("s")), s=F.lit(3 * 86400)) == "3 days ago"
    assert len(value(spark, text.shortened(F.col("t")), t=F.lit("x" * 100))) == 80
    assert value(spark, text.signed_percent(F.col("x")), x=F.lit(0.0327)) == "+3.27%"


def test_settings():
    from palim.settings import Settings, boolean, whole

    assert [boolean(x, True) for x in (" Off ", "yes", "maybe", None)] == [False, True, True, True]
    assert [whole(x, 60) for x in ("12", " 7 ", "x", None)] == [12, 7, 60, 60]
    made = Settings.of({"palim.reviews": "no", "palim.model.url": "http://x/", "palim.model.timeoutSeconds": "-4"})
    assert (made.reviews, made.model_url, made.timeout_seconds, made.consolidation_tasks, made.seed) == (False, "http://x", 60, 4, None)


def test_events(spark):
    from palim.functions import events

    rows = spark.createDataFrame([(1, '{"type": "message", "role": "USER", "content": "hi"}'), (2, '{"type": "other"}'), (3, '{"type": "message", "role": "system", "content": "x"}')], "id long, event string")
    got = events.messages(rows).select("id", events.text(F.lit(datetime(2026, 1, 2, 3, 4, 5)))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "[2026-01-02 03:04:05] user: hi"), (3, "[2026-01-02 03:04:05] system: x")]
    assert rows.limit(1).select(events.encode(F.lit("user"), F.lit("hi"))).first()[0] == '{"type":"message","role":"user","content":"hi"}'

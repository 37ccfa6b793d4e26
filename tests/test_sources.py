import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palim.sources import datasets, reports


@pytest.fixture
def dialogue(spark, tmp_path):
    turn = lambda t, **k: {"speaker": "Ann", "dia_id": "D1", "text": t, **k}
    sample = {
        "sample_id": "s1",
        "conversation": {
            "session_1": [turn("hi"), turn("  "), turn("look", blip_caption="a cat", search_query="cat photo"), {"speaker": " ", "dia_id": "x", "text": "hm", "blip_caption": "dog"}],
            "session_1_date_time": "1:56 pm on 8 May, 2023",
            "session_2": [turn("later")], "session_2_date_time": "12:05 am on 9 May, 2023",
            "session_4": [turn("never read")], "speaker_a": "Ann",
        },
        "qa": [{"question": "q1", "answer": 7, "category": 2, "evidence": ["D1"]}, {"question": "q2", "adversarial_answer": "no", "category": 5, "evidence": []}],
    }
    path = tmp_path / "d.json"
    path.write_text(json.dumps([sample]))
    return datasets.dialogues(spark, f"file://{path}")


def test_dialogue_messages(dialogue):
    rows = datasets.dialogue_messages(dialogue).orderBy("session", "turn").collect()
    assert [(r["session"], r["turn"], r["role"], r["content"]) for r in rows] == [
        (1, 0, "Ann", "hi"), (1, 2, "Ann", "look [Image: a cat; Image Retrieval Keywords: cat photo]"), (1, 3, "User", "hm [Image: dog]"), (2, 0, "Ann", "later"),
    ]
    assert rows[1]["ts"] == datetime(2023, 5, 8, 13, 58)
    assert rows[3]["ts"] == datetime(2023, 5, 9, 0, 5)


def test_questions(dialogue):
    assert [(r["question"], r["answer"]) for r in datasets.questions(dialogue).orderBy("place").collect()] == [("q1", "7"), ("q2", "no")]


def test_full_context(dialogue):
    text = datasets.full_context(dialogue).first()["context"]
    assert text.startswith("Below is a conversation between two people over multiple days.\n\nDATE: 1:56 pm on 8 May, 2023\nCONVERSATION:\nAnn said, \"hi\"")
    assert text.count("DATE:") == 2


@pytest.mark.parametrize(("text", "wanted"), [("12:00 pm on 1 June, 2023", datetime(2023, 6, 1, 12)), ("12:30 AM on 1 June, 2023", datetime(2023, 6, 1, 0, 30)), ("sometime", None), ("1:00 pm on 1 Smarch, 2023", None)])
def test_session_date(spark, text, wanted):
    assert spark.range(1).select(F.lit(text).alias("t")).select(datasets.session_date(F.col("t"))).first()[0] == wanted


def test_haystack(spark, tmp_path):
    sample = {
        "question_id": "q", "question_type": "multi-session", "question": "?", "question_date": "2023/05/30 (Tue) 23:40", "answer": 3, "answer_session_ids": ["b"], "haystack_dates": ["2023/05/20 (Sat) 02:21", "bad"],
        "haystack_session_ids": ["a", "b"], "haystack_sessions": [[{"role": "user", "content": "one"}, {"role": "assistant", "content": " "}, {"role": "user", "content": "two", "has_answer": True}], [{"role": "user", "content": "three"}]],
    }
    path = tmp_path / "h.json"
    path.write_text(json.dumps([sample]))
    rows = datasets.haystack_messages(datasets.haystacks(spark, f"file://{path}")).orderBy("session", "turn").collect()
    assert [(r["session"], r["turn"], r["content"], r["ts"]) for r in rows] == [(0, 0, "one", datetime(2023, 5, 20, 2, 21)), (0, 2, "two", datetime(2023, 5, 20, 2, 23)), (1, 0, "three", None)]
    path.write_text(json.dumps([sample | {"question_type": "other"}]))
    with pytest.raises(Exception, match="unknown question type"):
        datasets.haystacks(spark, f"file://{path}").collect()


def test_cache(spark, tmp_path):
    path = tmp_path / "cache"
    assert datasets.read_cache(spark, f"file://{path}").count() == 0
    path.mkdir()
    (path / "a.json").write_text('{"key": "a", "embedding": [1]}\n\n{"key": "a", "embedding": [2]}\n')
    datasets.append_cache(spark.createDataFrame([("b", [3.0])], "key string, embedding array<float>"), f"file://{path}")
    assert {r["key"]: r["embedding"] for r in datasets.read_cache(spark, f"file://{path}").collect()} == {"a": [2.0], "b": [3.0]}


def test_reports(spark, tmp_path):
    assert reports.fingerprint({"model": "m"}, ["b", "a"]) == reports.fingerprint({"model": "m"}, ["a", "b"]) != reports.fingerprint({"model": "n"}, ["a", "b"])
    schema = "sample_id string, category int, question string, score double, set_f1 double, judge double"
    results = spark.createDataFrame([("s", 1, "q1", 0.5, 0.5, 0.0), ("s", 2, "q2", 1.0, 0.0, 1.0)], schema)
    path = f"file://{tmp_path}/run"
    assert reports.load(spark, path, "x", schema).count() == 0
    reports.save(results, path, "x")
    reports.save(results.limit(1), path, "y")
    assert reports.load(spark, path, "x", schema).count() == 2
    questions = spark.createDataFrame([("s", 1, "q1"), ("s", 1, "q3"), ("s", 5, "q4")], "sample_id string, category int, question string")
    assert [r["question"] for r in reports.remaining(questions, results).collect()] == ["q3"]
    text = reports.markdown(results)
    assert "| 3 | 0 | 0.00% |" in text and "| all | 2 | 75.00% | 25.00% | 50.00% |" in text
    reports.write(results, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2 + 1 + 2 + 1

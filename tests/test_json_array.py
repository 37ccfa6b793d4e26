import json
import random

import pytest
from pyspark.sql import functions as F

from palim.operators import ordered
from palim.sources.json_array import json_array, json_objects, write_json_arrays

TEXTS = ['plain', 'a "quoted" }', "{[ }] ,", "back\\slash \\", 'end\\"', "}{", "[", '"', "\\\\\"}", "é 日本 😀", "", "line\nbreak\t}"]


def sample(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind <= 2:
        return rng.choice(TEXTS)
    if kind == 3:
        return rng.choice([1, -2.5, True, None])
    if kind == 4:
        return [sample(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(TEXTS) + str(i): sample(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_of_any_shape_wherever_the_file_is_cut(spark, tmp_path, monkeypatch, indent):
    rng = random.Random(3)
    objects = [{"id": i, "x": sample(rng), "y": {"z": [{}, sample(rng)]}} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(objects, indent=indent), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(objects[:7], indent=indent, ensure_ascii=False) + "\n" + json.dumps(objects[7:9]), encoding="utf-8")
    (tmp_path / "c.json").write_text(" [ ] ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = json_objects(spark, f"file://{tmp_path}")
        cut = spark.read.option("lineSep", "}").text(f"file://{tmp_path}/a.json")
        assert cut.rdd.getNumPartitions() > 20
        got = {}
        for r in rows.collect():
            got.setdefault(r["file"][-6], []).append((r["number"], json.loads(r["value"])))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [x for _, x in sorted(got["a"], key=lambda r: r[0])] == objects
    assert [x for _, x in sorted(got["b"], key=lambda r: r[0])] == objects[:9]
    assert set(got) == {"a", "b"}


def test_sums_by_small_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 8)
    objects = [{"k": i, "t": "}" * (i % 5), "u": {"v": [1, {"w": '"' * (i % 3)}]}} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    got = json_array(spark, f"file://{tmp_path}", "k int, t string, u struct<v:array<string>>").orderBy("k").collect()
    assert [(r["k"], r["t"]) for r in got] == [(o["k"], o["t"]) for o in objects]


def test_as_the_reader_of_whole_files(spark, tmp_path):
    objects = [{"a": i, "m": {"s": [{"x": "y}"}], "n": "1"}, "q": [{"b": [1, 2], "c": None}]} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(objects, separators=(",", ":")))  # of nested values as text, from_json drops blanks
    schema = "a int, m map<string,string>, q array<struct<b:array<int>,c:string>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(f"file://{tmp_path}")
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(json_array(spark, f"file://{tmp_path}", schema)) == key(whole)
    (tmp_path / "a.json").write_text('[{"a": "no number"}]')
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        json_array(spark, f"file://{tmp_path}", schema).collect()


def test_written_arrays_come_back(spark, tmp_path):
    rows = spark.range(50).repartition(7).select(F.to_json(F.struct("id")).alias("json"))
    write_json_arrays(rows, "json", f"file://{tmp_path}/x")
    assert sorted(r["id"] for r in json_array(spark, f"file://{tmp_path}/x", "id long").collect()) == list(range(50))
    for part in (tmp_path / "x").glob("part-*"):
        json.loads(part.read_text())
    write_json_arrays(rows.limit(0), "json", f"file://{tmp_path}/y")
    assert json_array(spark, f"file://{tmp_path}/y", "id long").count() == 0

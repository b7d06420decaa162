"""Readers and writers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import records as R
from tracewell.sources import sinks as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def raws(df):
    return [json.loads(r["raw"]) for r in df.orderBy("_pos").collect()]


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '﻿{"a": 1}\n\nbad\n[1]\n  {"a": 2},\n{"a": 3}\n')
    assert raws(R.read_jsonl(spark, p)) == [{"a": 1}, {"a": 3}]
    assert raws(R.read_jsonl(spark, p, trailing_commas=True)) == [{"a": 1}, {"a": 2}, {"a": 3}]
    with pytest.raises(Exception, match="malformed"):
        R.read_jsonl(spark, p, fail=True).select("data").collect()


def test_numbered(spark, tmp_path):
    p = write(tmp_path / "n.txt", "\n".join(f"line {i}" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = [(r["_pos"], r["value"]) for r in R.numbered(R.lines(spark, p)).orderBy("_pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"line {i}") for i in range(500)]


def test_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert raws(R.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"))) == [{"a": 1}, {"a": 2}]


@pytest.mark.parametrize("text,want", [
    ('[{"a": 1}, 5, {"b": 2}]', [{"a": 1}, {"b": 2}]), ('{"data": [{"a": 1}]}', [{"a": 1}]), ('{"x": 1}', [{"x": 1}]), ('{"a": 1}\nbroken\n{"a": 2},\n', [{"a": 1}, {"a": 2}]), ("[]", []), ("", []), ("5", []),
])
def test_records(spark, tmp_path, text, want):
    assert raws(R.read_records(spark, write(tmp_path / "r.json", text))) == want


def test_repair(spark, tmp_path):
    p = write(tmp_path / "cut.json", '[{"a": 1}, {"a": 2},')
    assert raws(R.read_records(spark, p, repair=True)) == [{"a": 1}, {"a": 2}]


def test_typed_keeps_key_order(spark, tmp_path):
    p = write(tmp_path / "k.json", '[{"z": "1", "a": 2}]')
    r = R.typed(R.read_records(spark, p), "a int, z string").first()
    assert r["_keys"] == ["z", "a"] and r["a"] == 2 and r["z"] == "1"


def test_slices_and_questions(spark, tmp_path):
    df = spark.range(10).withColumn("_pos", F.col("id"))
    assert [r["id"] for r in R.read_slice(df, 3, 4).orderBy("_pos").collect()] == [3, 4, 5, 6] and R.read_slice(df, 8, 9).count() == 2
    p = write(tmp_path / "q.jsonl", '{"question": " a "}\n{"question": " "}\n{"x": 1}\n')
    assert [r["question"] for r in R.read_questions(spark, p).collect()] == ["a"]


def test_training_and_guidance_rows(spark, tmp_path):
    p = write(tmp_path / "t.json", '[{"rationale": {"b": "x", "a": "y"}, "ans": 5}, {"id": "q1", "question": "Q", "options": "A) 1"}, {"question": " "}]')
    r = R.training_rows(R.read_records(spark, p)).orderBy("_pos").first()
    assert r["_rationale_keys"] == ["b", "a"] and r["response_ans"] == "5" and json.loads(r["response_rationale"]) == {"b": "x", "a": "y"}
    assert [(r["id"], r["question"]) for r in R.guidance_rows(R.read_records(spark, p), "ds").collect()] == [("q1", "Q\nA) 1")]


def test_ids_files_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), (None, "1"), (None, None), ("a", None)], "index string, id string")
    assert tuple(R.count_ids(df).first()) == (4, 3)
    write(tmp_path / "ids.txt", "b\n\na\n")
    assert [r["id"] for r in R.id_list(spark, str(tmp_path / "ids.txt")).orderBy("_pos").collect()] == ["b", "a"]
    write(tmp_path / "v.txt", "2 3\nfoo 0.5 1 2\nbar 1 0 0\n")
    assert {r["token"]: r["vec"] for r in R.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"foo": [0.5, 1.0, 2.0], "bar": [1.0, 0.0, 0.0]}
    assert R.files(spark, str(tmp_path), "*.txt").count() == 2


def test_response_shapes(spark):
    shapes = ['{"output_text": "a"}', '{"choices": [{"message": {"content": "b"}}]}', '{"output": [{"content": [{"text": "c"}, {"text": "d"}]}]}', '{"content": [{"text": "e"}]}', '{"content": "f"}', "{}"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string")
    assert [r["t"] for r in df.select("i", R.response_text(F.try_parse_json("s")).alias("t")).orderBy("i").collect()] == ["a", "b", "cd", "e", "f", None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("10", 1), ("9", 2)], "id string, n int")
    S.write_jsonl(df, str(tmp_path / "o"), order="id")
    S.write_jsonl(df, str(tmp_path / "o"), mode="append")
    assert spark.read.json(str(tmp_path / "o")).count() == 4
    S.write_text(df, "id", str(tmp_path / "t"))
    S.write_labels(df.withColumn("file", F.col("id")), str(tmp_path / "l"))
    assert json.loads((tmp_path / "l" / "10.labels.jsonl").read_text()) == {"id": "10", "n": 1} and not (tmp_path / "l.new").exists()
    S.write_report(df, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep" / "csv")).count() == 2
    for n in (1, 2):
        S.append_history(spark.createDataFrame([(n,)], "k int"), str(tmp_path / "h"))
    assert S.latest_summary(spark.read.parquet(str(tmp_path / "h"))).first()["k"] == 2


def test_json_array_and_tree(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "id string, n int")
    for rows in (df, df.limit(0), df):
        S.write_json_array(rows, str(tmp_path / "a.json"), "n")
        assert json.loads((tmp_path / "a.json").read_text()) == ([{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"n": 3}] if rows is df else [])
    S.write_labels(df.withColumn("file", F.concat(F.lit("x/y é="), "id")), str(tmp_path / "t"))
    assert sorted(p.relative_to(tmp_path / "t").as_posix() for p in (tmp_path / "t").rglob("*.jsonl")) == ["x/y é=a.labels.jsonl", "x/y é=b.labels.jsonl"]


def test_binary_vectors(spark, tmp_path):
    df = spark.createDataFrame([("é", [0.5, 1.0]), ("b", [2.0, -1.0])], "token string, vec array<float>")
    S.write_vectors(df, str(tmp_path / "v.bin"))
    assert (tmp_path / "v.bin").read_bytes().startswith(b"2 2\nb ")
    assert {r["token"]: r["vec"] for r in R.read_vectors(spark, str(tmp_path / "v.bin"), binary=True).collect()} == {"é": [0.5, 1.0], "b": [2.0, -1.0]}


def test_finished(spark, tmp_path):
    p = write(tmp_path / "s.jsonl", '{"id": "a", "samples": [1, 2]}\n{"id": "a", "samples": [1]}\n{"id": "b"}\n{"x": 1}\n{"id": "c", "samp')
    assert {r["id"]: r["n"] for r in R.finished(spark, p, "id").collect()} == {"a": 2, "b": 1}
    assert R.finished(spark, p, "id", "samples").where("id = 'a'").first()["n"] == 2


def test_lines_are_not_read_whole(spark, tmp_path):
    p = write(tmp_path / "big.jsonl", "\n".join(json.dumps({"i": i}) for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = R.read_records(spark, p)
        assert R.lines(spark, p).rdd.getNumPartitions() > 1 and "MapInPandas" not in got._jdf.queryExecution().toString() and [r["i"] for r in raws(got)] == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pivoted(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 3)], "r string, c string, n int")
    assert S.markdown(S.pivoted(df, "r", "c", "n")).splitlines() == ["| r | x | y |", "|---|---|---|", "| a | 1 | 2 |", "| b |  | 3 |"]


def test_stringified(spark):
    df = spark.createDataFrame([(None, True, 5, ["a"]), ("x", None, None, None)], "s string, b boolean, n int, l array<string>")
    assert [tuple(r) for r in S.stringified(df).collect()] == [("", "True", "5", '["a"]'), ("x", "", "", "")]

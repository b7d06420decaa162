"""Plain texts of nested values and parsing of loose model output."""

from pyspark.sql import functions as F

from tracewell.functions import loose as L


def one(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_plain_text(spark):
    cases = {None: "", " a ": "a", '{"A": "x", "B": {"C": ["p", "q!"]}}': "A: x. B: C: p. q!", "[1, null, true]": "1. True.", '"\\"in\\""': "in"}
    assert one(spark, list(cases), L.plain_text) == list(cases.values())
    assert L.flat_text({"a": 1, "b": 2}, ["b"]) == "b: 2. a: 1."


def test_clean_answer(spark):
    assert one(spark, ["5.0", "2.5", '{"a": "b"}', "text", None, "nan"], L.clean_answer) == ["5", "2.5", "a: b.", "text", "", "nan"]


def test_reordered(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null, "c": 3}', ["c", "b"]), ("x", ["a"]), (None, None)], "t string, k array<string>")
    assert [r[0] for r in df.select(L.reordered(F.col("t"), F.col("k"))).collect()] == ['{"c": 3, "b": null, "a": 1}', None, None]


def test_parsed_output(spark):
    got = one(spark, ["```json\n{\"rationale\": \"r\", \"ans\": \"7\"}\n```", "{'ans': 'b', 'rationale': 'x'}", "<answer> 12 </answer>", "so it is 3, then 1,234", "nothing", None, '{"ans": 1, broken'], L.parsed_output)
    assert (got[0]["rationale"], got[0]["ans"]["n"]) == ("r", 7.0)
    assert (got[1]["rationale"], got[1]["ans"]["s"]) == ("x", "B")
    assert (got[2]["rationale"], got[2]["ans"]["n"]) == (None, 12.0)
    assert (got[3]["rationale"], got[3]["ans"]["n"]) == ("so it is 3, then 1,234", 1234.0)
    assert got[4]["ans"] is None and got[5]["ans"] is None and got[6]["ans"]["n"] == 1.0

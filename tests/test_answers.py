"""The scorer and the extractors on hand-derived cases."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import answers as A


def one(spark, values, build, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("build,cases", [
    (A.number, {"42": 42.0, " 1,234 ": 1234.0, "x #### 5.": 5.0, r"\frac{1}{2}": 0.5, r"-\frac34": -0.75, "1/2": 0.5, "1/0": 1.0, r"3\sqrt{2}": 3.0, "no": None, "1d": 1.0, "1_000": 1000.0, "": None, "−3/4": -0.75, "1e3": 1000.0, None: None}),
    (A.last_number, {"a 1 b -2.5 c": "-2.5", "none": None}),
    (A.final_number, {r"so \boxed{7} or 9": "7", "The answer is 12 of 13\nor 4": "13", "yes 5": None, "3 then 4": "4", "abc": None}),
    (A.choice_in_text, {"<answer> c </answer>": "C", "Answer: b": "B", "option E": "E", "answer 3": "C", "choice: 2.0": "B", "nothing": None}),
    (A.first_choice, {"(b)": "B", "I see A": "A", "zzz": None}),
    (A.truth, {"Yes.": True, "**false**": False, "maybe": None, "": None}),
    (A.tagged, {"<Answer> 5 </Answer>": "5", "⟨answer⟩x⟨/answer⟩": "x", "<answer></answer>": "", "no": None}),
    (A.guided_number, {"The answer is 42.": "42", "so #### 5": "5", '{"ans": 123}': "123", "-15.": "-15", "3.14": "3.14", "1,234": "1234", "none": None}),
    (A.guided_choice, {"The answer is C.": "C", "Answer is (B).": "B", '{"ans": "D"}': "D", "answer is e": "E", "Option A seems close, but the answer is B.": "B", "xyz": None}),
    (A.guided_truth, {"Yes, it is": "yes", "No, not": "no", '{"ans": true}': "yes", '{"ans": false}': "no", "At first yes, but ultimately no.": "no", "unclear": None, "true.": "yes", "false.": "no"}),
    (A.norm_number, {"1,000.0": "1000", "2.5": "2.5", "X": "x"}),
    (A.teacher_choice, {"the correct answer is **(d)**": "D", '"ans": "b"': "B", "<answer>A</answer>": "A", "zzz": None}),
    (A.quoted_fraction, {'{"ans": 800/9}': '{"ans": "800/9"}'}),
])
def test_text_builders(spark, build, cases):
    assert dict(zip(cases, one(spark, list(cases), build), strict=True)) == cases


def test_twelve_digits(spark):
    xs = [0.5, 1.0, 123456789012.0, 1234567890123.0, 0.0001, 0.00001, -2.5, 1 / 3, 0.0, 1e300, 1e-300, 100000.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r["y"] for r in df.select("i", A.twelve_digits(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [f"{x:.12g}" for x in xs]


def test_normalise_and_match(spark):
    rows = [("true", "1", True), ("C", "c", True), ("0.5", "1/2", True), ("10", "11", False), ("yes", "True", True), ("Paris", " paris", True), ("C", "3", False), ("nan", "nan", False), ("inf", "inf", True), ("1000000", "1000000.5", True), (None, None, True), (None, "1", False), ("", "", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, p string, want boolean")
    got = df.select("i", "want", A.matches(A.normalize(A.raw("g")), A.normalize(A.raw("p"))).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [r["want"] for r in got]


def test_json_answers(spark):
    cases = {
        '{"rationale": {}, "ans": 42}': ("n", "42"), '{"ans": "1/2"}': ("s", "1/2"), '{"ans": true}': ("b", "true"), 'think... {"ans": "B"} end': ("s", "B"),
        json.dumps(json.dumps({"ans": 7})): ("n", "7"), "{'x': 1, ans: 'it\\'s'}": ("s", "it's"), '{"rationale": "cut, "ans": 5, ': ("s", "5"), "no json here": None, '{"ans": null}': ("s", "null"), '{"ans": ""}': ("s", ""), None: None,
    }
    got = one(spark, list(cases), A.text_ans)
    assert [None if g is None else (g["kind"], g["text"]) for g in got] == list(cases.values())


def score(spark, rows, cols, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in cols))
    return [r["_ok"] for r in A.with_match(df, **kw).orderBy("i").select("_ok").collect()]


def test_scorer_numbers(spark):
    rows = [("42", '{"rationale": {"Step": "Step1: ..."}, "ans": 42}'), ("0.5", '{"rationale": {}, "ans": "1/2"}'), ("10", '{"rationale": {}, "ans": 11}'), ("10", "truncated output without a closing brace"), (None, '{"ans": 1}'), ("5", None), ("5", "")]
    assert score(spark, rows, ["gold_ans", "model_response"]) == [True, True, False, False, False, False, False]


def test_scorer_choices(spark):
    opts = "A) 10\nB) 20\nC) 30"
    rows = [("C", '{"rationale": {}, "ans": "C"}', None), ("A", '{"rationale": {}, "ans": "B"}', None), ("C", '{"ans": 3}', None), ("B", '{"ans": "20"}', opts), ("B", "I think option b", None), ("B", "<answer>2</answer>", None)]
    assert score(spark, rows, ["gold_ans", "model_response", "options"]) == [True, False, True, True, True, True]


def test_scorer_prose_and_objects(spark):
    assert score(spark, [("5", "adds up to 5"), ("true", "The answer is yes."), ("7", r"so \boxed{7}")], ["gold_ans", "model_response"]) == [True, True, True]
    assert score(spark, [("5", '{"content": "the answer is 5"}'), ("9", '{"ans": 9}')], ["gold_ans", "model_response"], object_responses=True) == [True, True]
    assert score(spark, [("5", "5", "9")], ["gold_ans", "model_ans", "model_response"]) == [True]


def test_options(spark):
    assert one(spark, ["A) x\nB. y\nA: z", "none", None], A.option_map) == [{"B": "y", "A": "z"}, None, None]
    df = spark.createDataFrame([(5.0,), (15.0,), (11.0,)], "n double").withColumn("m", A.option_map(F.lit("A) 10\nB) 20")))
    assert [r[0] for r in df.select(A.nearest_option(F.col("m"), F.col("n"))).collect()] == ["A", None, "A"]


def test_registries():
    with pytest.raises(KeyError):
        A.extractor("song")
    assert A.normalizer("song") is not None

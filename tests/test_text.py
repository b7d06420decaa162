"""Text expressions: tokens, steps, reject reasons, ids, chats."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T


def one(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("build,cases", [
    (T.label_tokens, {"StateFinalAnswer": ["state", "final", "answer"], "set_up2": ["set", "up", "2"], "STANDARD ANODIZED": ["anodized"], "FOO_BAR": ["bar"], "HTTPServer": ["http", "server"], "": [], None: None}),
    (T.trim_words, {"a b c d e": "a b c d", " a  b ": " a  b ", "": "", None: None}),
    (T.strip, {"\xa0 x\t\n": "x", " ": "", None: None}),
    (T.step_count, {"1. a\n2. b\n3. c": 3, "1) a\n2) b\n3) c": 3, "- a\n- b\n- c\n- d\n- e\n- f": 6, "Step 1: a\nStep 2: b\nStep 3: c\nStep 4: d": 4, "a\nb\nc": 3, "1. only": 1, " \n ": 0, None: 0, "a b": 2}),
    (T.final_token, {"the end 5": "5", " ": None, None: None}),
    (T.slug, {" Llama-3.1 8B! ": "llama-3-1-8b", "": ""}),
])
def test_builders(spark, build, cases):
    assert one(spark, list(cases), build) == list(cases.values())


THREE = "1. Find what is known.\n2. Relate the parts.\n3. Combine them."


@pytest.mark.parametrize("text,want", [
    (THREE, []), ("One step only.", ["too_few_steps"]), ("\n".join(f"{i}. s" for i in range(1, 8)), ["too_many_steps"]), ("", ["empty"]), (None, ["empty"]),
    (THREE + " 3 + 4 = 7", ["contains_arithmetic", "contains_equation"]), (THREE + " 12 * 5", ["contains_arithmetic"]), (THREE + " x = 42", ["contains_equation"]), (THREE + " Therefore the answer is 42.", ["contains_final_answer_number"]),
    (THREE + "\nThe answer is (C).", ["contains_choice_answer"]), (THREE + " 123456", ["contains_long_numbers"]), (THREE + " a × b", ["contains_unicode_math"]), (THREE + " Let x2 and y be.", []),
])
def test_reject_reasons(spark, text, want):
    assert one(spark, [text], T.reject_reasons) == [want]


def test_marked(spark):
    got = one(spark, ["why #### 5", "5", None, "a #### b #### c"], T.answer_of_marked)
    assert [tuple(g) for g in got] == [("why", "5"), ("", "5"), ("", ""), ("a", "b")]
    got = one(spark, ["why #### 5", "why", None], T.rationale_of_marked)
    assert [tuple(g) for g in got] == [("why", "5"), ("why", ""), ("", "")]


def test_ids_and_options(spark):
    df = spark.createDataFrame([("a b/c", 3, "Q?", "A) 1"), ("...", 4, "Q? A) 1", "A) 1"), (None, 5, "Q?", " ")], "x string, p int, q string, o string")
    got = df.select(T.safe_id("x", "svamp", F.col("p")).alias("i"), T.with_options("q", "o").alias("q"), T.first_text("o", "q").alias("f")).collect()
    assert [r["i"] for r in got] == ["a_b_c", "svamp_00004", "svamp_00005"]
    assert [r["q"] for r in got] == ["Q?\nOptions:\nA) 1", "Q? A) 1", "Q?"]
    assert [r["f"] for r in got] == ["A) 1", "A) 1", "Q?"]


def test_chat(spark):
    df = spark.createDataFrame([("s", "u", "a")], "s string, u string, a string")
    r = df.select(T.chat_text(T.chat(F.col("s"), F.col("u"), F.col("a"))).alias("t"), T.chat_text(T.chat(F.col("s"), F.col("u")), generate=True).alias("g")).first()
    assert r["t"] == "[INST] s\n\nu [/INST] a" and r["g"] == "[INST] s\n\nu [/INST]"


def test_choice_rule(spark):
    assert one(spark, ["Give <numeric>. " + T.ANSWER_RULES["text"]], T.with_choice_rule) == ['Give <A|B|C|D|E>. Put the letter of one option into "ans": A, B, C, D, E.']

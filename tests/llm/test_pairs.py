"""Defects of pairs, truncation, prefix neighbours."""

import random

import pytest

from tracewell.llm import pairs as P

Q = "Ruma packs 19 tiles in the morning and 50 in the evening. How many tiles does Ruma pack that day?"
LONG = "Step 1: Each group holds 36 pebbles, so 52 groups hold 52 * 36 = 1872 pebbles.\nStep 2: Adding both amounts gives 69."


@pytest.mark.parametrize("value,want", [
    (None, "empty"), ("", "empty"), (" \n​", "empty"), ("N/A", "empty"), ("{}", "empty"), ("[]", "empty"), ('{"rationale": {}, "ans": null}', "empty"), ('{"ans": "", "rationale": {"A": ""}}', "empty"), ("<answer></answer>", "empty"), ("```json\n```", "empty"), ("-", "empty"),
    ("69", None), ("no", None), ("A", None), ('{"rationale": {}, "ans": "69"}', None), (LONG + "\nAnswer: 69", None), (LONG + " #### 69", None), ("The question is: " + Q + " Adding gives 69. Hence 69 is correct.", None), ("So the result is 99.", None),
    (LONG[:-20], "truncated"), (LONG + " Then again, it is tem", "truncated"), (LONG + " Then we...", "truncated"), ('{"rationale": {"A": "Step1: Adding both', "truncated"), (LONG[:70] + "�", "truncated"), (LONG + " and so [truncated]", "truncated"),
    ("I'm sorry, but I cannot help with this question.", "refusal"), ("Unfortunately, let's skip this one. Could you try another question?", "refusal"), ('{"rationale": {"A": "I must decline to solve this one."}, "ans": null}', "refusal"), ("Lo siento, no puedo ayudar con esta pregunta.", "refusal"),
    ("The data fit more than one value, so the answer is B: it cannot be determined more closely.", None), ("We can't divide by zero, so the case is left out. Answer: 4", None),
    (Q, "copied"), ("Question: " + Q, "copied"), (Q.lower().rstrip("?"), "copied"), (Q + "\n" + Q, "copied"), ('"' + Q + '"', "copied"), (Q.replace(" in the evening", ""), "copied"), ('{"rationale": {"RestateGoal": "%s"}, "ans": "%s"}' % (Q, Q), "copied"),
    ("Складываем обе величины и получаем 19 + 50 = 69. Ответ: 69.", "language"), ("Die Antwort lautet 69, also insgesamt 69 Stück.", "language"), ("Cada niño lleva 19 cajas, así que en total hay 69. La respuesta es 69.", "language"), ("所以一共是69个。答案是69。", "language"),
])
def test_rules(value, want):
    defect, _ = P.Rules().judge("model_response", Q, None, value)
    # an open end waits for evidence from other values
    assert defect == want or (want == "truncated" and defect == "open")


@pytest.mark.parametrize("value,want", [("42", None), ("B", None), (r"\frac{1}{2}", None), ("####", "empty"), ("null", "empty"), ("(the second opti", "truncated"), ("12 crayons, because every he", "truncated"), (r"\text{not poss", "truncated"), ("nicht möglich", "language"), ("ninguna de las anteriores", "language"), (Q, "copied")])
def test_gold(value, want):
    assert P.Rules().judge("gold_ans", Q, None, value)[0] == want


def test_nulls_and_long_texts():
    r = P.Rules()
    assert r.judge("model_response", None, None, "La respuesta es 69.") == (None, None)
    assert r.judge("model_response", "", "", Q) == (None, None)
    assert r.judge("model_response", Q, None, (LONG + " ") * 5000 + "Answer: 1") == (None, None)
    assert r.judge("model_response", Q, None, "[" * 100_000) == ("empty", None)


def test_long_refusals():
    why = " The matter lies outside of what I may talk about, and a person with the right training would be of more help here." * 4
    assert len(why) > 400
    assert P.Rules().judge("model_response", Q, None, "I'm sorry, but I cannot help with this question." + why) == ("refusal", None)
    assert P.Rules().judge("model_response", Q, None, "I cannot help with fractions, but 19 + 50 = 69 is plain." + why)[0] is None


def by_brute_force(unfinished, finished):
    return {u for u in unfinished if any(t != u and t.startswith(u) for t in finished)}


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_shortened(spark, parts):
    rnd = random.Random(7)
    finished = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 14))) for _ in range(150)}
    unfinished = {t[: rnd.randrange(1, len(t) + 1)] for t in finished if rnd.random() < 0.6} | {"zz", "b", "".join("ab" * 20)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "text string").repartition(3)
        got = [r["text"] for r in P.shortened(frame(unfinished), frame(finished)).collect()]
        assert set(got) == by_brute_force(unfinished, finished)
        assert len(got) == len(set(got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_tails():
    assert P.tails("It is 52. As before, each of the 36 groups ho") == ("As before, each of the  groups ho", "each of the  groups ho")
    assert P.tails("Each of 3") == ("Each of ", None)


@pytest.fixture(scope="module")
def evidence(spark):
    whole = "Adding both amounts gives 69, so the stock stays as it was. Answer: 69"
    rows = [(i, "a", whole) for i in range(3)]
    rows += [(10, "a", "First of all, adding both amounts gives 7, so the stock sta")]  # goes on elsewhere
    rows += [(11, "a", "A sentence that nobody else writes without a final stop")]  # an open end, but no evidence
    rows += [(20 + i, "cut", "word%03d " % i * 24 + "wor") for i in range(6)]  # the source's limit
    rows += [(40 + i, "cut", "word%03d " % i * (14 + i % 8) + "wor. Answer: 1") for i in range(20)]
    rows += [(70, "a", '{"rationale": {"A": "Adding'), (71, "a", "Adding both amo...")]
    return spark.createDataFrame([(i, s, Q, "69", None, v) for i, s, v in rows], "pred_id long, source string, question string, gold_ans string, options string, model_response string")


def test_each_evidence_decides(evidence):
    found = lambda *without: {r["pred_id"] for r in P.truncations(evidence, without).collect()}
    cut = set(range(20, 26))
    assert found() == {10, 70, 71} | cut
    assert found("prefix") == {70, 71} | cut
    assert found("limit") == {10, 70, 71}
    assert {r["pred_id"] for r in P.truncated(evidence).collect()} == found()
    assert {(r["evidence"], r["n"], r["n_alone"]) for r in P.by_evidence(evidence).collect()} == {("prefix", 1, 1), ("limit", 6, 6), ("structure", 1, 1), ("mark", 1, 1)}


def test_one_defect_for_each_pair(spark):
    answer = "Cada niño lleva 19 cajas y la suma de las cantidades es 69"
    rows = [(1, answer), (2, answer + " y entonces no queda nada. Respuesta: 69")]
    p = spark.createDataFrame([(i, "s", Q, "69", None, v) for i, v in rows], "pred_id long, source string, question string, gold_ans string, options string, model_response string")
    got = [tuple(r) for r in P.defects(P.prediction_pairs(p, "model_response"), P.response_sizes(p)).select("row_id", "defect").collect()]
    assert sorted(got) == [(1, "truncated"), (2, "language")]


def test_tables(spark):
    p = spark.createDataFrame([(1, "s", Q, "69", None, LONG[:60], 5), (1, "s", Q, "69", None, LONG[:60], 6), (2, "s", Q, None, None, LONG + "\nAnswer: 69", 5), (3, None, Q, "69", None, None, 5)], "pred_id long, source string, question string, gold_ans string, options string, model_response string, value int")
    t = spark.createDataFrame([(1, Q, None, "I cannot help with this question.")], "teacher_id long, question string, options string, response_rationale string")
    got = {tuple(r) for r in P.found(p, t).collect()}
    assert got == {("predictions", 1, "model_response", "truncated"), ("predictions", 2, "gold_ans", "empty"), ("predictions", 3, "model_response", "empty"), ("teacher", 1, "response_rationale", "refusal")}
    assert P.truncated(p).collect()[0]["pred_id"] == 1
    assert P.found(p.limit(0), t.limit(0)).count() == 0
    by = {r["source"]: (r["n"], r["n_truncated"]) for r in P.by_source(p).collect()}
    assert by == {"s": (2, 1), None: (1, 0)}


def test_limits(spark):
    rows = [("a", "x" * 512)] * 30 + [("a", "x" * (300 + i)) for i in range(150)] + [("b", "x" * (400 + i)) for i in range(100)]
    got = P.limits(spark.createDataFrame(rows, "source string, value string")).collect()
    assert {(r["source"], r["unit"], r["size_limit"]) for r in got} == {("a", "chars", 512), ("a", "bytes", 512)}


def test_no_defects_at_all(spark):
    p = spark.createDataFrame([(i, "s", Q, "69", None, LONG + "\nAnswer: 69") for i in range(50)], "pred_id long, source string, question string, gold_ans string, options string, model_response string")
    assert P.truncated(p).count() == 0


def test_refusal_cues_follow_from_the_pattern():
    assert P.literals(r"\bi (?:cannot|can't)\b|no solution\b[^.]{0,9}here|\b(?:so )?sorry") == ["i can", "no solution", "sorry"]
    for text in ("I cannot help with this question.", "Let's skip this one.", "Lo siento, no puedo ayudar.", "抱歉，我不能回答。", "Das kann ich leider nicht beantworten.", "It isn't permitted."):
        low = text.lower()
        assert not P.REFUSAL.search(low) or any(c in low for c in P.REFUSAL_CUES)
        assert P.Rules.refusal([text])

"""Label mapping: repair rules, whole pipeline, edge cases."""

import random

import pytest

from tracewell.llm import canonical as C

LABELS = [(1, "category", "Ratio and Proportion"), (2, "category", "Work and Speed"), (3, "category", "Unit Conversion"), (11, "intent", "Scale a Recipe"), (12, "intent", "Last Digit of Power"), (21, "step", "StateFinalAnswer"), (22, "step", "SpotPattern"), (23, "step", "ComputeTotal")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*x, None) for x in LABELS], "label_id long, kind string, label string, parent_id long")


def mapped(spark, labels, kind, values):
    df = spark.createDataFrame([(kind, v) for v in values], "kind string, value string")
    return {r["value"]: r["label_id"] for r in C.map_labels(df, labels).collect()}


VALUES = [
    ("category", "ratio_and_proportion", 1), ("category", "RatioAndProportion", 1), ("category", "ratioandproprtion", 1), ("category", "Proportion, Ratio and", 1), ("category", "and Speed Work", 2), ("category", "wrok & spede", 2),
    ("category", "3. Ratio and Prop.", 1), ("category", "Rаtio and Proportion", 1), ("category", "ＷＯＲＫ ＡＮＤ ＳＰＥＥＤ", 2), ("category", "Step 4: work/and/speed (general)", 2), ("category", "Unit Testing", 0), ("category", "n/a", 0), ("category", "???", 0), ("category", "qxzvbk", 0),
    ("category", "unknown 93", 0), ("intent", "scale a reci.", 11), ("intent", "units digit of a power", 12), ("intent", "Share a Photo", 0), ("step", "statefinalansw.", 21), ("step", "STATING_FINAL_ANSWER", 21), ("step", "notice the pattern", 22), ("step", "Total, Compute", 23), ("step", "ShareScreen", 0), ("step", "ComputeTotal", 23),
]


@pytest.fixture(scope="module")
def all_mapped(spark, labels):
    df = spark.createDataFrame([(k, v) for k, v, _ in VALUES], "kind string, value string")
    return {(r["kind"], r["value"]): r["label_id"] for r in C.map_labels(df, labels).collect()}


@pytest.mark.parametrize("kind,value,want", VALUES)
def test_values(all_mapped, kind, value, want):
    assert all_mapped[kind, value] == want


def test_random_slips_are_repaired(spark, labels):
    rnd = random.Random(5)
    want = {}
    for i, kind, label in LABELS:
        for _ in range(15):
            s = list(label)
            at = rnd.randrange(1, len(s) - 1)
            how = rnd.randrange(3)
            if how == 0:
                del s[at]
            elif how == 1:
                s.insert(at, rnd.choice("aeiou"))
            else:
                s[at], s[at + 1] = s[at + 1], s[at]
            want[kind, "".join(s)] = i
    df = spark.createDataFrame(list(want), "kind string, value string")
    got = {(r["kind"], r["value"]): r["label_id"] for r in C.map_labels(df, labels).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.97 * len(want)


def test_edges(spark, labels):
    assert mapped(spark, labels, "category", [None, "", "   ", "​"]) == {"​": 0}
    assert mapped(spark, labels, "nothing", ["Work and Speed"]) == {"Work and Speed": 0}
    empty = labels.limit(0)
    assert mapped(spark, empty, "category", ["Work and Speed"]) == {"Work and Speed": 0}
    long = "work and speed " * 3000
    assert list(mapped(spark, labels, "category", [long])) == [long]


@pytest.mark.parametrize("bound", [1, 20_000])
def test_long_lists_are_joined(spark, labels, bound, monkeypatch):
    monkeypatch.setattr(C, "MAX_VOCABULARY", bound)
    got = mapped(spark, labels, "category", ["ratio_and_proportion", "wrok & spede", "Unit Testing"])
    assert got == {"ratio_and_proportion": 1, "wrok & spede": 2, "Unit Testing": 0}


def test_found(spark, labels):
    route = "struct<category:string,intent:array<string>,reasoning_path:array<string>>"
    rows = [(1, ("work_and_speed", ["Scale a Recipe", None, " ", "scale recipe"], None)), (1, ("work_and_speed", ["Scale a Recipe", None, " ", "scale recipe"], None)), (2, None), (3, (None, [], ["StateFinalAnswer", "spot patern"])), (4, ("Work and Speed", None, ["misc"]))]
    t = spark.createDataFrame(rows, f"teacher_id long, route {route}").withColumnRenamed("x", "x")
    got = sorted(tuple(r) for r in C.found(t, labels).select("teacher_id", "field", "pos", "label_id").collect())
    assert got == [(1, "category", 0, 2), (1, "intent", 3, 11), (3, "reasoning_path", 1, 22), (4, "reasoning_path", 0, 0)]
    assert C.found(t.limit(0), labels).count() == 0


def test_clashing_columns(spark, labels):
    df = spark.createDataFrame([("category", "work_and_speed", 7, "x")], "kind string, value string, label_id int, token string")
    assert C.map_labels(df, labels).select("label_id").first()[0] == 2


def test_distance():
    assert [C.osa(a, b, 3) for a, b in [("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("", "ab"), ("kitten", "sitting"), ("abcd", "wxyz")]] == [0, 1, 1, 2, 3, 4]


def test_segments_meet():
    """A token within the allowed edits of a word shares one of its segments."""
    rnd = random.Random(3)
    for _ in range(400):
        word = "".join(rnd.choice("abcdef") for _ in range(rnd.randrange(3, 20)))
        e = C.budget(len(word), True)
        s = list(word)
        for _ in range(rnd.randrange(e + 1)):
            at = rnd.randrange(len(s))
            if rnd.random() < 0.5:
                s[at] = rnd.choice("xyz")
            elif len(s) > 2:
                del s[at]
        filed = {(e, len(word), i, p) for i, _, p in C.segments(word, e)}
        assert filed & set(C.probes("".join(s), True))


def test_swaps_across_segment_borders_meet():
    """Each swap may spoil two segments, so two of them four."""
    for word, token in (("abcdefgh", "acbdegfh"), ("abcdefgh", "abdcefhg"), ("abcdefghij", "abdcefhgij")):
        e = C.budget(len(word), False)
        filed = {(e, len(word), i, p) for i, _, p in C.segments(word, e)}
        assert C.osa(word, token, 3) == 2 and filed & set(C.probes(token, False))

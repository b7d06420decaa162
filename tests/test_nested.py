"""Stream parser, pivots and the tables of second-round records."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.operators import nested as N

JSON = st.recursive(st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=5), x, max_size=4), max_leaves=20)


def flat(x, path="", ords=(), names=()):
    if isinstance(x, dict):
        out = [(path, ords, names, "object", None)]
        for k, v in x.items():
            out += flat(v, f"{path}.{k}" if path else k, ords, names)
        return out
    if isinstance(x, list):
        out = [(path, ords, names, "array", None)]
        for i, v in enumerate(x):
            out += flat(v, path + "[]", (*ords, i), (*names, None))
        return out
    if x is None:
        return [(path, ords, names, "null", None)]
    if isinstance(x, bool):
        return [(path, ords, names, "boolean", json.dumps(x))]
    return [(path, ords, names, "string" if isinstance(x, str) else "number", x if isinstance(x, str) else json.dumps(x))]


@given(st.dictionaries(st.text(min_size=1, max_size=5), JSON, max_size=5), st.sampled_from([None, 2]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_triples_equal_a_tree_walk(doc, indent, ascii_only):
    assert N.triples_of(json.dumps(doc, indent=indent, ensure_ascii=ascii_only)) == flat(doc)


@pytest.mark.parametrize("text", ["", "null", "[1]", '"x"', "{", '{"a": 1', '{"a": 1,}', '{"a" 1}', '{"a": 1} x', "{'a': 1}", '{"a": 01}', '{"a": [1,]}', '{"a": nan}', '{"a": "\n"}', "teacher timed out", '{"a": tru}', '{,}', '{"a": "\\x"}'])
def test_incomplete(text):
    with pytest.raises(N.Incomplete):
        N.triples_of(text)


@given(st.text(alphabet='{}[]",:01 antru\\', max_size=25))
@settings(max_examples=400, deadline=None)
def test_same_validity_as_json(text):
    try:
        ok = isinstance(json.loads(text, parse_constant=lambda _: 1 / 0), dict)
    except (ValueError, ZeroDivisionError):
        ok = False
    try:
        N.triples_of(text)
        assert ok
    except N.Incomplete:
        assert not ok


def test_depth_and_repeated_keys():
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    assert len(N.triples_of(deep)) == 5001
    assert N.triples_of('{"a": {"x": 1}, "b": 2, "a": 3}') == [("", (), (), "object", None), ("b", (), (), "number", "2"), ("a", (), (), "number", "3")]


def test_open_and_embedded():
    t = N.triples_of('{"r": {"k1": "v", "k2": {"text": "w"}}, "e": "{\\"i\\": [1]}"}', open_objects=frozenset({"r"}), embedded=frozenset({"e"}))
    assert ("r{}", (0,), ("k1",), "string", "v") in t and ("r{}.text", (1,), ("k2",), "string", "w") in t and ("e.i[]", (0,), (None,), "number", "1") in t


def test_lone_texts_as_lists():
    t = N.triples_of('{"a": "x", "b": [["y"], "z"], "c": " ", "d": 1}', lists=frozenset({"a", "b", "b[]", "c", "d"}))
    assert ("a[]", (0,), (None,), "string", "x") in t and ("b[][]", (1, 0), (None, None), "string", "z") in t and ("b[][]", (0, 0), (None, None), "string", "y") in t
    assert ("c", (), (), "array", None) in t and not [x for x in t if x[0] == "c[]"] and ("d", (), (), "number", "1") in t


def children(spark, payloads):
    df = spark.createDataFrame([(i, p, 1, "x") for i, p in enumerate(payloads)], "record_id long, payload string, received_at int, pos string")
    return sorted(tuple(r) for r in N.second_round_children(df).collect())


def test_children(spark):
    route = {"category": "c", "intent": "lone", "reasoning_path": ["a", "b"], "reasoning_path_options": [["x"], [], ["y", "z"]]}
    got = children(spark, [
        json.dumps({"reasoning_path_bank": route, "rationale": {"S1": "t", "S2": {"text": "t", "note": 1}}, "reasoning_path_final": {"intent": ["i", "j"]}, "samples": [{"text": "t", "pred": "5"}]}),
        json.dumps({"response_payload": {"route": json.dumps({"intent": ["k"]})}, "rationale": [{"step": "A", "checks": [{"expr": "1+1"}, {"expr": "2"}]}, {"step": "B", "checks": []}]}),
        json.dumps({"reasoning_path_bank": None, "route": {"intent": []}, "rationale": None, "samples": None}), None, "", "[1]", '{"route": ', json.dumps({"rationale": "", "reasoning_path_final": "{"}),
    ])
    assert got == sorted([
        (0, "bank_intent", 0, 0, "lone"), (0, "bank_path", 0, 0, "a"), (0, "bank_path", 0, 1, "b"), (0, "bank_option", 0, 0, "x"), (0, "bank_option", 2, 0, "y"), (0, "bank_option", 2, 1, "z"),
        (0, "rationale", 0, 0, "S1"), (0, "rationale", 0, 1, "S2"), (0, "final_intent", 0, 0, "i"), (0, "final_intent", 0, 1, "j"), (0, "sample", 0, 0, "5"),
        (1, "bank_intent", 0, 0, "k"), (1, "rationale", 0, 0, "A"), (1, "rationale", 0, 1, "B"), (1, "check", 0, 0, "1+1"), (1, "check", 0, 1, "2"),
    ])


def test_deliveries_and_empty(spark):
    p = json.dumps({"rationale": {"S": "t"}})
    df = spark.createDataFrame([(1, p, 1), (1, p.replace(" ", "  "), 2), (1, None, 3), (None, p, 1)], "record_id long, payload string, received_at int")
    assert [tuple(r) for r in N.second_round_children(df).collect()] == [(1, "rationale", 0, 0, "S")]
    assert N.second_round_children(df.limit(0)).count() == 0


def test_pivot(spark):
    rnd = random.Random(1)
    docs = [{"o": [{"q": i, "l": [{"n": rnd.randrange(9)} for _ in range(rnd.randrange(3))]} for i in range(rnd.randrange(4))]} for _ in range(20)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k long, j string")
    t = N.triples(df, "k", "j")
    outer = sorted((r["key"], r["ordinals"][0], r["q"]) for r in N.pivot(t, "o[]", {"q": "q"}).collect())
    assert outer == [(i, a, str(x["q"])) for i, d in enumerate(docs) for a, x in enumerate(d["o"])]
    inner = sorted((r["key"], *r["ordinals"], r["n"]) for r in N.pivot(t, "o[].l[]", {"n": "n"}).collect())
    assert inner == [(i, a, b, str(y["n"])) for i, d in enumerate(docs) for a, x in enumerate(d["o"]) for b, y in enumerate(x["l"])]
    assert {r["ancestor"] for r in N.explore(t).collect()} >= {"o[]", "o[].l[]"}
    both = N.pivots(t, {"o[]": {"q": "q"}, "o[].l[]": {"n": "n"}}).collect()
    assert sorted((r["key"], r["ordinals"][0], r["q"]) for r in both if r["ancestor"] == "o[]") == outer
    assert sorted((r["key"], *r["ordinals"], r["n"]) for r in both if r["ancestor"] == "o[].l[]") == inner

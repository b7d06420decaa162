"""Queries of the catalogue over whole tables, against brute force on small fixtures."""

import datetime as dt
import random
from collections import defaultdict
from math import comb
from statistics import mean, stdev

import pytest

from tracewell.plans import catalogue as C

PREDICTIONS = "pred_id long, source string, dataset string, method string, model string, run int, index string, gold_ans string, model_response string, model_ans string, options string, ingested_at timestamp"


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


# gold, response, answer and whether they match
KINDS = [
    ("4", "The answer is 5", "4", True),
    ("4", '{"ans": "4"}', None, True),
    ("4", "I can't help with that.", None, False),
    ("4", None, None, False),
    ("4", "x", "", False),
    ("Blue Whale", "x", "blue whale", True),
    ("1,200 km", "x", "1200", True),
    (None, "x", "7", False),
    ("7", "so the answer is 9", None, False),
]


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = []
    for i in range(700):
        g, r, a, ok = rnd.choice(KINDS)
        rows.append((i, "s", rnd.choice("xy"), rnd.choice(["CoT", "SGFT", "DCoT"]), "m", rnd.choice([1, 2, 3]), f"q{rnd.randrange(60)}", g, r, a, None, at(i), ok))
    path = put(spark, tmp_path_factory.mktemp("judged"), "predictions", [r[:-1] for r in rows] + [r[:-2] + (at(5000),) for r in rows[:50]], PREDICTIONS)
    return path, [dict(dataset=r[2], method=r[3], run=r[5], index=r[6], ok=r[-1]) for r in rows]


def groups(rows, *by):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[b] for b in by)].append(r["ok"])
    return out


def test_accuracies_count_every_prediction(spark, judged):
    path, rows = judged
    got = {r["dataset"]: (r["correct"], r["total"]) for r in C.accuracy_rollup(spark, path).collect()}
    assert got == {k[0]: (sum(v), len(v)) for k, v in groups(rows, "dataset").items()} | {None: (sum(r["ok"] for r in rows), 700)}
    acc = {k: 100 * mean(v) for k, v in groups(rows, "dataset", "method", "run").items()}
    per = defaultdict(list)
    for (d, m, _), v in acc.items():
        per[d, m].append(v)
    got = {(r["dataset"], r["method"]): (r["mean"], r["std"], r["n_runs"]) for r in C.mean_std_by_run(spark, path).collect()}
    assert got == {k: (pytest.approx(mean(v), abs=1e-5), pytest.approx(stdev(v), abs=1e-5), 3) for k, v in per.items()}
    ids = groups(rows, "index", "run")
    shared = {i for i, _ in ids if all((i, n) in ids for n in (1, 2, 3))}
    want = groups([r for r in rows if r["index"] in shared], "run")
    assert {r["run"]: (r["accuracy"], r["n"]) for r in C.run_accuracy(spark, path).collect()} == {k[0]: (pytest.approx(100 * mean(v), abs=1e-5), len(v)) for k, v in want.items()}
    q = [(len(v), sum(v)) for v in groups(rows, "index").values()]
    want = {k: (pytest.approx(mean(1 - comb(n - c, k) / comb(n, k) for n, c in q if n >= k), abs=1e-5), sum(n >= k for n, _ in q)) for k in (1, 3, 5)}
    assert {r["k"]: (r["mean"], r["n_rows"]) for r in C.pass_at_k(spark, path).collect()} == want


def test_gaps_count_every_prediction(spark, judged):
    path, rows = judged
    acc = {k: 100 * mean(v) for k, v in groups(rows, "dataset", "method", "run").items()}
    of = lambda m, n: mean(acc[d, m, n] for d in "xy")
    base = mean(of("CoT", n) for n in (1, 2, 3))
    got = {r["method"]: r["gap"] for r in C.welch_gap(spark, path).collect()}
    assert got == {m: pytest.approx(mean(of(m, n) for n in (1, 2, 3)) - base, abs=1e-5) for m in ("SGFT", "DCoT")}
    assert C.pooled_controls(spark, path).first()["gap"] == pytest.approx(mean(of(m, n) for m in ("SGFT", "DCoT") for n in (1, 2, 3)) - base, abs=1e-5)
    assert C.average_gap(spark, path).first()["gap"] == pytest.approx(mean(of("SGFT", n) for n in (1, 2, 3)) - base, abs=1e-5)


def test_safe_ids_of_long_positions(spark, tmp_path):
    docs = [(7, "?"), (10000, ""), (99999, None), (100000, "??"), (100001, "__"), (1234567, " "), (100002, "a b")]
    path = put(spark, tmp_path, "documents", docs, "doc_id long, source string")
    got = {r["doc_id"]: r["name"] for r in C.safe_ids(spark, path).collect()}
    assert got == {7: "doc_00007", 10000: "doc_10000", 99999: "doc_99999", 100000: "doc_100000", 100001: "doc_100001", 1234567: "doc_1234567", 100002: "a_b"}


def test_extraction_runs_over_every_prediction(spark, tmp_path):
    rows = [
        # gold, response, answer, dataset
        ("1,200 km", "The answer is (B)", "3/4", "yesno"),
        ("Blue Whale", '{"ans": "12"}', None, "yesno"),
        (None, "so #### 1,234", "$5", "other"),
        ("Yes", "gives 7 then 9", "true", "yesno"),
        (r"\frac{1}{2}", "nothing here", "NO ", "yesno"),
        ("NO ", None, "false", "yesno"),
    ]
    path = put(spark, tmp_path, "predictions", [(i, "s", d, "CoT", "m", 1, "q", g, r, a, None, at(i)) for i, (g, r, a, d) in enumerate(rows)], PREDICTIONS)
    of = lambda q, *c: [tuple(r[x] for x in c) for r in q(spark, path).orderBy("pred_id").collect()]
    assert of(C.choice_extract, "choice") == [("B",), (None,), (None,), (None,), (None,), (None,)]
    assert of(C.labels_canonical, "gold") == [("1200",), ("blue whale",), ("__MISSING__",), ("true",), ("0.5",), ("false",)]
    assert of(C.guided_numbers, "n") == [(None,), ("12",), ("1234",), ("9",), (None,), (None,)]
    assert of(C.normalize_match, "gold", "pred") == [
        ("n:1200.000000", "n:0.750000"), ("s:blue whale", None), (None, "n:5.000000"), ("b:1", "b:1"), ("n:0.500000", "b:0"), ("b:0", "b:0"),
    ]
    assert [tuple(r) for r in C.normalised_accuracy(spark, path).collect()] == [("s", 5, 2)]


def test_options_and_numbers_run_over_every_question(spark, tmp_path):
    rows = [
        ("1", "Blue", "A) 5 km\nB) 5 miles\nC) 12 cm"),
        ("2", "$5", "A) 12 km\nB) 13 km"),
        ("3", "7", "A) 12 km\nB) 12 kg"),
        ("4", None, "A) red\nB) green"),
    ]
    path = put(spark, tmp_path, "questions", [(i, "d", "Q?", a, o) for i, a, o in rows], "id string, dataset string, question string, answer string, options string")
    of = lambda q, c: {r["id"]: r[c] for r in q(spark, path).collect()}
    assert of(C.nearest_option, "letter") == {"1": "C", "2": "A", "3": None, "4": None}
    assert of(C.option_unique_match, "letter") == {"1": None, "2": "A", "3": None, "4": "A"}
    assert of(C.number_coerce, "value") == {"1": "s:blue", "2": "n:5.000000", "3": "n:7.000000", "4": None}


def test_paths_with_null_steps_are_kept(spark, tmp_path):
    route = "struct<category:string,intent:array<string>,difficulty:int,budget:int,reasoning_path:array<string>,reasoning_path_options:array<array<string>>>"
    paths = [["a", None], ["a", None], ["a"], [None, "a"], ["x", None], [None]]
    options = [[["a", None]], None, [["b"]], [["a", None]], [["x", None], ["y"]], [["a"]]]
    rows = [(i, ("c", ["i"], 1, 2, p, o), at(i)) for i, (p, o) in enumerate(zip(paths, options, strict=True))]
    put(spark, tmp_path, "teacher", rows, f"teacher_id long, route {route}, ingested_at timestamp")
    path = put(spark, tmp_path, "bank", [("c", "i", 0, ["b"]), ("c", "i", 1, ["x", None])], "category string, intent string, path_pos int, reasoning_path array<string>")
    assert sorted(r["path"] for r in C.new_signatures(spark, path).collect()) == ["a", "a>~", "~", "~>a"]
    got = [(r["path_pos"], r["path"]) for r in C.merged_bank(spark, path).orderBy("path_pos").collect()]
    assert got == [(0, "b"), (1, "x>~"), (2, "a>~"), (3, "a"), (4, "~>a"), (5, "~")]
    own, llm = "reasoning_path_bank", "llm_generated"
    assert {r["teacher_id"]: r["source"] for r in C.path_sources(spark, path).collect()} == {0: own, 2: llm, 3: llm, 4: own, 5: llm}


def test_average_gap_over_many_datasets(spark, tmp_path):
    rows = [(f"d{d}", m, run, run == 1 or (m == "SGFT" and d >= 100)) for d in range(104) for m in ("CoT", "SGFT") for run in (1, 2)]
    p = [(i, "s", d, m, "m", run, "q", "4", "x", "4" if ok else "5", None, at(i)) for i, (d, m, run, ok) in enumerate(rows)]
    path = put(spark, tmp_path, "predictions", p, PREDICTIONS)
    assert C.average_gap(spark, path).first()["gap"] == pytest.approx(50 * 4 / 104, abs=1e-5)

"""Statistics on published and hand-computed values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import metrics as M

BASE = [48.42, 48.12, 49.44, 49.12, 48.62, 48.66, 49.08, 49.26, 48.24, 48.60]
ARM = [48.58, 48.28, 48.66, 48.36, 48.28, 48.22, 48.04, 47.62, 48.76, 48.56]


def values(spark):
    return spark.createDataFrame([("baseline", x) for x in BASE] + [("randglobal", x) for x in ARM] + [("one", 5.0)], "arm string, acc double")


def test_mean_std(spark):
    got = {r["arm"]: (round(r["mean"], 2), round(r["std"], 2)) for r in M.mean_std(values(spark), "acc", "arm").collect()}
    assert got == {"baseline": (48.76, 0.45), "randglobal": (48.34, 0.34), "one": (5.0, 0.0)}


def test_welch(spark):
    rows = M.welch_gaps(values(spark), "acc", "arm", "baseline").collect()
    assert [r["arm"] for r in rows] == ["randglobal"]
    r = rows[0]
    assert (round(r["gap"], 2), round(r["lo"], 2), round(r["hi"], 2), r["significant"], round(r["df"], 2)) == (-0.42, -0.79, -0.05, True, 16.71)
    same = spark.createDataFrame([("baseline", 1.0), ("baseline", 1.0), ("b", 1.0), ("b", 1.0)], "arm string, acc double")
    r = M.welch_gaps(same, "acc", "arm", "baseline").first()
    assert (r["gap"], r["df"], r["significant"]) == (0.0, 1.0, False)


def test_average_gap(spark):
    g = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 2.0, 4.0)], "gap double, lo double, hi double")
    r = M.average_gap(g).first()
    assert r["gap"] == 2.0 and abs((r["hi"] - r["lo"]) / 2 - math.sqrt(2) / 2) < 1e-12


def test_t_table(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (11.0,), (100.0,), (500.0,), (0.5,)], "x double")
    got = [r[0] for r in df.select(M.t975(F.col("x"))).collect()]
    assert [None if g is None else round(g, 4) for g in got] == [12.706, 8.5045, 2.2035, 1.984, 1.984, None]


def test_pass_at_k(spark):
    cases = [(10, 5, 3), (5, 3, 3), (4, 0, 2), (6, 1, 1), (3, 1, 4), (20, 20, 5)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, c long, k int")
    got = [r["p"] for r in df.select("i", M.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).orderBy("i").collect()]
    want = [None if k > n else 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k) for n, c, k in cases]
    assert all((g is None and w is None) or abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True))
    assert round(got[0], 6) == 0.916667


def test_path_stats(spark):
    rnd = random.Random(1)
    paths = [tuple(rnd.choice("ab") for _ in range(rnd.randrange(0, 3))) for _ in range(200)]
    df = spark.createDataFrame([(list(p),) for p in paths] + [(None,)], "path array<string>")
    real = [p for p in paths if p]
    n, k = len(real), len(set(real))
    h = -sum(real.count(p) / n * math.log2(real.count(p) / n) for p in set(real))
    r = M.path_stats(df, "path").first()
    assert (r["n"], r["k"]) == (n, k) and abs(r["entropy"] - h) < 1e-9 and abs(r["perplexity"] - 2**h) < 1e-9 and abs(r["reuse"] - (1 - k / n)) < 1e-12
    assert M.path_stats(df.limit(0), "path").count() == 0
    r = M.path_stats(spark.createDataFrame([(["x"],)] * 3, "path array<string>"), "path").first()
    assert (r["entropy"], r["entropy_norm"], r["perplexity"], r["share2"], r["top1"]) == (0, 0, 1, 1, 1)


def test_shared_ids_and_runs(spark):
    df = spark.createDataFrame([("r1", "a", True), ("r1", "b", False), ("r2", "a", False), ("r2", "c", True)], "run string, id string, _ok boolean")
    assert [r["id"] for r in M.shared_ids(df, "run", "id").collect()] == ["a"]
    assert {r["run"]: r["accuracy"] for r in M.run_accuracy(df, "run", "id").collect()} == {"r1": 100.0, "r2": 0.0}


def test_reports(spark):
    df = spark.createDataFrame([("x", 1, None)], "a string, b int, c double")
    assert M.markdown(df) == "| a | b | c |\n|---|---|---|\n| x | 1 |  |"
    with pytest.raises(ValueError):
        M.markdown(spark.range(5), max_rows=2)
    with pytest.raises(ValueError):
        M.assert_unique(spark.createDataFrame([("k",), ("k",)], "id string"), "id")
    r = M.accuracy(spark.createDataFrame([], "_ok boolean")).first()
    assert (r["correct"], r["total"], r["accuracy"]) == (0, 0, None)


def test_most_frequent_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert tuple(M.most_frequent(df, "v").first()) == ("a", 2)

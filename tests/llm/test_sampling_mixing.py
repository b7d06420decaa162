"""Quota samples and mixes: invariants, infeasible targets, edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing as M
from tracewell.llm import sampling as S

TARGETS = [(1, "A", None, 5000, 3), (2, "B", "x", 3000, 2), (3, "C", None, 1500, 2), (4, "D", None, 500, 1)]


def data(spark, n=2000, hot=0.6, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = "A" if rnd.random() < hot else rnd.choice(["B", "B", "C", None, "E"])
        rows.append((i, c, rnd.choice(["x", "y", None])))
    return spark.createDataFrame(rows, "key long, category string, intent string"), rows


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame(TARGETS, "target_id int, category string, intent string, share_bp int, min_rows int")


def test_sample(spark, targets):
    df, rows = data(spark)
    size = S.fifth(df)
    out = S.sample(df, targets, size).collect()
    have = Counter(1 if c == "A" else 2 if c == "B" and i == "x" else 3 if c == "C" else None for _, c, i in rows)
    n = Counter(r["target_id"] for r in out)
    assert len(out) == 400 and len({r["key"] for r in out}) == 400
    assert all(n[t] <= have[t] for t in n) and n[4] == 0
    assert all((r["target_id"], r["category"]) in {(1, "A"), (2, "B"), (3, "C")} for r in out)
    again = {r["key"] for r in S.sample(df.repartition(7), targets, size).collect()}
    assert again == {r["key"] for r in out}


def test_shortfalls(spark, targets):
    df, rows = data(spark)
    got = {r["target_id"]: (r["need"], r["available"], r["missing"]) for r in S.shortfalls(df, targets, S.fifth(df)).collect()}
    b = sum(c == "B" and i == "x" for _, c, i in rows)
    assert got[2] == (120, b, max(0, 120 - b)) and got[4] == (20, 0, 20) and got[1][0] == 200


def test_quotas_sum_and_minimums():
    rnd = random.Random(1)
    for _ in range(300):
        groups = {g: rnd.randrange(0, 120) for g in "abc"}
        rows = []
        for t in range(rnd.randrange(1, 8)):
            g = rnd.choice("abc")
            rows.append((t, rnd.randrange(0, 4000), rnd.randrange(0, 6), rnd.randrange(0, 60), rnd.randrange(0, groups[g] + 1), g))
        n = rnd.randrange(0, 200)
        q = S.quotas(rows, groups, n)
        drawn = {g: sum(q[t] for t, *_, h in rows if h == g) for g in groups}
        can = sum(min(groups[g], sum(h for *_, h, k in rows if k == g)) for g in groups)
        low = S.quotas([(t, s, m, 0, h, g) for t, s, m, _, h, g in rows], groups, 0)
        assert all(0 <= q[t] <= h for t, _, _, _, h, _ in rows) and all(drawn[g] <= groups[g] for g in groups)
        assert all(q[t] >= low[t] for t in q) and sum(q.values()) == min(max(n, sum(low.values())), can)


def test_whole_category_draws_what_intents_leave(spark):
    rows = [(i, "A", "x") for i in range(1000)] + [(1000 + i, "A", None if i % 2 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "key long, category string, intent string")
    t = spark.createDataFrame([(1, "A", "x", 1000, 10), (2, "A", None, 9000, 500), (3, "A", "x", 1, 5)], "target_id int, category string, intent string, share_bp int, min_rows int")
    size = spark.createDataFrame([(600,)], "n long")
    out = S.sample(df, t, size).collect()
    n = Counter(r["target_id"] for r in out)
    assert len({r["key"] for r in out}) == len(out) == 600 and n[2] >= 500 and n[1] >= 10 and n[3] == 0
    assert sum(r["cell"] == "x" for r in out if r["target_id"] == 2) > 400
    got = {r["target_id"]: (r["need"], r["available"], r["missing"], r["quota"]) for r in S.shortfalls(df, t, size).collect()}
    assert got[1][:3] == (60, 1000, 0) and got[2][:3] == (540, 1100, 0) and got[3][1] == 1000
    assert {k: v[3] for k, v in got.items()} == {1: n[1], 2: n[2], 3: 0}


def test_sample_edges(spark, targets):
    df, _ = data(spark, 50)
    assert S.sample(df.limit(0), targets, S.fifth(df.limit(0))).count() == 0
    assert S.sample(df, targets.limit(0), S.fifth(df)).count() == 0
    clash = df.withColumns({c: F.lit(1) for c in ("need", "n", "target_id", "slice", "priority", "slice_a", "cell", "first", "_c", "_rank")})
    same = targets.withColumns({c: F.lit(1) for c in ("need", "n", "available", "size")})
    assert {r["key"] for r in S.sample(clash, same, S.fifth(clash)).collect()} == {r["key"] for r in S.sample(df, targets, S.fifth(df)).collect()}
    assert S.shortfalls(clash, same, S.fifth(clash)).count() == 4


def test_teacher_records(spark):
    route = "struct<category:string,intent:array<string>>"
    t = spark.createDataFrame([(1, ("A", ["x", "y"])), (1, ("A", ["x", "y"])), (2, ("A", [])), (3, None), (None, ("A", ["x"]))], f"teacher_id long, route {route}")
    assert sorted((r["key"], r["category"], r["intent"]) for r in S.teacher_records(t).collect())[:2] == [(1, "A", "x"), (2, "A", None)]
    assert S.teacher_records(t).count() == 3


def test_schedule_is_pfair():
    w = {"a": 5000, "b": 3333, "c": 1200, "d": 467}
    n = 3000
    got = M.schedule(w, n)
    assert len({s for *_, s in got}) == len(got)
    done = Counter()
    at = {slot: s for s, _, slot in got}
    for t in range(n):
        done[at.get(t)] += 1
        for s, x in w.items():
            assert abs(done[s] - x * (t + 1) / 10_000) < 1
    assert M.schedule({}, 10) == [] and M.schedule({"a": 0}, 10) == []


def sized(spark, n=3000):
    rnd = random.Random(4)
    rows = [(i, "big" if i % 3 else rnd.choice(["small", None, "none", "mid"]), rnd.choice([0, 5, 40, 100, 300])) for i in range(n)]
    return spark.createDataFrame(rows, "key long, source string, n_tokens long"), rows


MIX = [("big", 4000, 2), ("small", 3500, 2), ("mid", 2000, 5), ("gone", 500, 3)]


@pytest.mark.parametrize("block_tokens", [100_000, 7])
def test_mix(spark, block_tokens):
    df, rows = sized(spark)
    t = spark.createDataFrame(MIX, "source string, weight_bp int, max_repeats int")
    out = M.mix(df, t, block_tokens=block_tokens).collect()
    total = sum(n for *_, n in rows)
    slots = max(1, -(-total // (M.PERIOD * block_tokens))) * M.PERIOD
    has = Counter()
    for _, s, n in rows:
        has[s] += n
    got = Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    assert len({(r["key"], r["repeat"]) for r in out}) == len(out)
    assert all(r["repeat"] < dict((s, m) for s, _, m in MIX)[r["source"]] for r in out)
    for s, w, m in MIX:
        assert abs(got[s] - min(total * w // 10_000, has[s] * m)) <= 300
    assert not {r["source"] for r in out} & {None, "none", "gone"}
    rep = {r["source"]: r for r in M.report(df, t).collect()}
    assert rep["gone"]["taken"] == 0 and not rep["gone"]["reached"] and rep["big"]["reached"]
    # any beginning of the mix holds the shares that the whole has, to within a block and a document
    order = sorted(out, key=lambda r: (r["slot"], r["place"]))
    assert (max(r["slot"] for r in order) > M.PERIOD) == (slots > M.PERIOD)
    for part in (0.25, 0.5, 0.6):
        upto = Counter()
        for r in order:
            if r["slot"] < slots * part:
                upto[r["source"]] += r["n_tokens"]
        assert abs(upto["big"] - total * 0.4 * part) <= total / slots + 300


def test_more_weight_than_all(spark):
    df, _ = sized(spark, 30)
    with pytest.raises(ValueError):
        M.mix(df, spark.createDataFrame([("big", 9000, 2), ("mid", 2000, 1)], "source string, weight_bp int, max_repeats int"))


def test_mix_edges(spark):
    df, _ = sized(spark, 30)
    t = spark.createDataFrame(MIX, "source string, weight_bp int, max_repeats int")
    assert M.mix(df.limit(0), t).count() == 0
    assert M.mix(df, t.limit(0)).count() == 0
    assert M.report(df.limit(0), t).count() == 4
    clash = df.withColumns({c: F.lit(1) for c in ("has", "total", "slot", "place", "repeat", "block", "weight_bp", "_b", "start")})
    assert sorted(map(tuple, M.mix(clash, t.withColumn("has", F.lit(1))).collect())) == sorted(map(tuple, M.mix(df, t).collect()))

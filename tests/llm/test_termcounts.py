"""Term counts against a count by hand, deltas against a rebuild."""

import datetime as dt
import random
from collections import Counter

import re

from tracewell.llm import termcounts as TC

ROUTE = "struct<category:string,intent:array<string>,reasoning_path:array<string>>"
SCHEMA = f"teacher_id long, route {ROUTE}, ingested_at timestamp, term string, n_records int"


def rows(n=60, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        route = None if rnd.random() < 0.1 else (rnd.choice(["A", " B", None, ""]), None, rnd.choice([None, [], ["ComputeTotal", None, "", "computeTotal2x"], ["StateFinalAnswer", "StateFinalAnswer"], ["é Draw-Sketch"]]))
        for k in range(rnd.choice([1, 1, 2])):
            out.append((i, route, dt.datetime(2025, 1, 1 + k + i % 20), "clash", 9))
    return out


def by_hand(data):
    occ, rec = Counter(), Counter()
    seen = {i: r for i, r, *_ in data}
    for route in seen.values():
        if route is None:
            continue
        v = [("category", route[0])] if route[0] is not None else []
        for s in route[2] or []:
            if s is not None:
                v.append(("step", s))
                v += [("term", t) for t in re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", s).lower())]
        occ.update(v)
        rec.update(set(v))
    return {k: (occ[k], rec[k]) for k in occ}, len(seen)


def as_dict(df):
    return {(r["field"], r["term"]): (r["n_occurrences"], r["n_records"]) for r in df.collect()}


def test_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want, n = by_hand(data)
    assert as_dict(TC.counts(df)) == want
    marks = {(r["field"], r["term"]): r["mark"] for r in TC.found(df).collect()}
    assert marks == {k: m for k, (_, r) in want.items() if (m := "rare" if r < 3 else "common" if r > n / 4 else None)}


def test_batches_equal_rebuild(spark):
    df = spark.createDataFrame(rows(80, 4), SCHEMA)
    assert as_dict(TC.in_batches(df, spark).counts()) == as_dict(TC.counts(df))


def test_many_batches_reopened_and_repeated(spark, tmp_path):
    data = rows(90, 7)
    path = str(tmp_path / "state")
    order = sorted(data, key=lambda r: r[2])
    for k in range(0, len(order), 30):
        batch = spark.createDataFrame(order[k : k + 30], SCHEMA)
        for _ in range(2):  # a batch that comes again changes nothing
            TC.TermCounts(spark, path).apply(batch, "teacher_id", ["ingested_at"], TC.teacher_values())
    want, n = by_hand(order)
    got = TC.TermCounts(spark, path)
    assert got.version == 2 * -(-len(order) // 30) and as_dict(got.counts()) == want and got.n_records().first()["n"] == n


def test_merge_moves_no_state(spark, tmp_path):
    s = TC.TermCounts(spark, str(tmp_path / "s"), buckets=4)
    s.apply(spark.createDataFrame(rows(40, 2), SCHEMA), "teacher_id", ["ingested_at"], TC.teacher_values())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = spark.createDataFrame([("term", "compute", 1, 1)], "field string, term string, d_occurrences long, d_records long")
        plan = TC.merge(s.counts(), changes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # of the changes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_changes_and_deletions(spark):
    t = lambda day: dt.datetime(2025, 1, day)
    data = [(1, ("A", None, ["x y"]), t(1)), (1, ("B", None, ["x"]), t(2)), (2, ("A", None, ["x"]), t(1)), (3, ("Z", None, None), t(1)), (3, None, t(2)), (None, ("Q", None, None), t(1))]
    df = spark.createDataFrame(data, f"teacher_id long, route {ROUTE}, ingested_at timestamp")
    want = {("category", "A"): (1, 1), ("category", "B"): (1, 1), ("step", "x"): (2, 2), ("term", "x"): (2, 2)}
    assert as_dict(TC.counts(df)) == want and as_dict(TC.in_batches(df, spark).counts()) == want
    assert as_dict(TC.in_batches(df, spark, "2025-01-01 12:00:00").counts()) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert TC.counts(df).count() == 0 and TC.found(df).count() == 0

"""Joins between runs, samples, providers, prompts, streams, and the entry point."""

import datetime as dt
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import reject_reasons
from tracewell.operators import providers, relations, sampling
from tracewell.plans import prompts as P
from tracewell.streaming.growth import BankGrowth, once_each, running_accuracy, stale, windowed_counts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_resume(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    done = spark.createDataFrame([("a", 2), ("a", 3)], "id string, n_done int")
    assert {r["id"] for r in relations.not_done(df, done, "id").collect()} == {"b", None}
    assert {r["id"]: r["need"] for r in relations.top_up(df, done, "id", 4).collect()} == {"a": 1, "b": 4, None: 4}
    got = relations.reuse(df.where("id is not null"), spark.createDataFrame([("a", None)], "id string, v string"), "id", "v", F.upper("id"))
    assert {r["id"]: r["v"] for r in got.collect()} == {"a": None, "b": "B"}


def test_signatures(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    relations.enforce_same(a, a)
    with pytest.raises(ValueError, match="n: 1 and 2"):
        relations.enforce_same(a, spark.createDataFrame([(2, "x")], "n int, s string"))
    with pytest.raises(ValueError):
        relations.first_by_text_id(spark.range(3), "id", 5)
    assert [r["id"] for r in relations.first_by_text_id(spark.range(12), "id", 3).collect()] == [0, 1, 10]


def test_zip_and_latest(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "a array<int>, b array<string>")
    assert [tuple(x) for x in df.select(relations.zipped(F.col("a"), F.col("b")).alias("z")).first()["z"]] == [(1, "a"), (2, "b")]
    d = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, t int")
    assert relations.latest_per_key(d, "k", "t").first()["v"] == "new"


def test_random_other(spark):
    donors = spark.createDataFrame([(i, f"p{i}", "hot" if i < 30 else f"k{i}") for i in range(40)], "i int, path string, k string")
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{30 + i % 10}") for i in range(400)], "id int, own string")
    got = relations.random_other(rows, donors, key="id", own="own", donor="path", donor_key="k", seed=1).collect()
    key = {r["path"]: r["k"] for r in donors.collect()}
    assert len(got) == 400 and all(key[r["path"]] != r["own"] for r in got) and len({r["path"] for r in got}) > 15
    only = donors.where("k = 'hot'")
    assert relations.random_other(rows.where("own = 'hot'"), only, key="id", own="own", donor="path", donor_key="k", seed=1).where("path is null").count() == 0


def test_random_other_draws_from_the_whole_bank(spark):
    donors = spark.createDataFrame([(f"p{i}", "hot" if i < 1900 else f"k{i}") for i in range(2000)], "path string, k string")
    rows = spark.createDataFrame([(i, "hot" if i % 5 == 0 else f"k{1900 + i % 100}") for i in range(10000)], "id int, own string")
    got = relations.random_other(rows, donors, key="id", own="own", donor="path", donor_key="k", seed=1).collect()
    key = {r["path"]: r["k"] for r in donors.collect()}
    assert len(got) == 10000 and all(key[r["path"]] != r["own"] for r in got)
    assert len({r["path"] for r in got}) > 1900
    hot = Counter(r["path"] for r in got if r["own"] == "hot")
    assert len(hot) == 100 and sum((n - 20) ** 2 / 20 for n in hot.values()) < 160
    unkeyed = relations.random_other(rows.limit(5), donors.limit(0), key="id", own="own", donor="path", donor_key="k", seed=1)
    assert unkeyed.where("path is null").count() == 5


def test_proportional_sample(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("aaaaaabbc") if i % 50 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, c string")
    got = Counter(r["c"] for r in sampling.proportional_sample(df, "c", "id", 90).collect())
    n = Counter(c for _, c in rows)
    assert sum(got.values()) == 90 and all(abs(got[c] - n[c] / 10) < 1 for c in n)
    assert sampling.proportional_sample(df, "c", "id", 5000).count() == 900
    assert sampling.proportional_sample(df.limit(0), "c", "id", 5).count() == 0


def test_allocation(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 2)], "pos int, n int")
    assert [r["alloc"] for r in sampling.allocation(df, "n", 5, "pos").orderBy("pos").collect()] == [3, 1, 1]


def test_perturbed(spark):
    rows = [(i, f"c{i % 3}", "i", 2, [f"s{i % 5}", "x", "y"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, category string, intent string, budget int, reasoning_path array<string>")
    r = {x["id"]: x["reasoning_path"] for x in sampling.perturbed(df, "random", "id", "id").collect()}
    assert len(r) == 30 and all(len(p) == 2 for p in r.values())
    g = {x["id"]: x["reasoning_path"] for x in sampling.perturbed(df, "randglobal", "id", "id").collect()}
    assert all(g[i] != p for i, _, _, _, p in rows)
    assert sampling.perturbed(df, "empty", "id", "id").where("size(reasoning_path) > 0").count() == 0
    with pytest.raises(ValueError):
        sampling.perturbed(df, "song", "id", "id")


def test_providers(spark):
    calls = []

    def flaky(system, user):
        calls.append(user)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    waits = []
    assert providers.with_retry(flaky, sleep=waits.append)("s", "u") == "ok" and waits == [1.0, 2.0]
    df = spark.createDataFrame([(1, "s", "What is 5"), (2, None, None)], "id int, system string, user string")
    got = {r["id"]: r["reply"] for r in providers.complete(df, providers.echo_completer, keep=["id"]).collect()}
    assert '"ans": "5"' in got[1] and '"ans": ""' in got[2]

    def broken():
        def ask(system, user):
            raise ValueError("no")
        return ask

    r = providers.complete(df, broken, keep=["id"]).first()
    assert r["reply"] is None and r["reply_error"] == "no"


def test_embedder_and_validation(spark):
    e = providers.hashing_embedder(16)
    assert e(["a b", "a b", ""]).shape == (3, 16) and (e(["a b"]) == e(["a b"])).all()
    df = spark.createDataFrame([(1, "s", "bad"), (2, "s", "1. a\n2. b\n3. c")], "id int, system string, user string")
    got = {r["id"]: (r["valid"], r["retried"]) for r in providers.validated(df, lambda: (lambda s, u: u), key="id", reasons=reject_reasons, retry_suffix="\nline").collect()}
    assert got == {1: (True, True), 2: (True, False)}
    ok, bad, n = providers.accepted_rejected(df, "user", reject_reasons)
    assert (ok.count(), bad.count(), tuple(n.first())) == (1, 1, (2, 1, 1))


def test_prompts(spark):
    q = spark.createDataFrame([("1", "quantmc", "Q?", "A", "A) 1\nB) 2"), ("2", "yesno", "R?", None, None)], "id string, dataset string, question string, answer string, options string")
    p = P.prompts(q, spark)
    assert p.count() == 2 * len(P.STRATEGIES)
    m = P.smoke_matrix(p, {"question": "Question:", "schema": '"ans"'}).collect()
    assert all(r["n"] == r["n_ok"] for r in m)
    r = p.where("id = '1' and strategy = 'cot'").first()
    assert "<A|B|C|D|E>" in r["user"] and "A) 1" in r["user"] and r["task"] == "choice"
    sv = spark.createDataFrame([("7", "Body ", " Q", 3)], "ID string, Body string, Question string, Answer int")
    assert tuple(P.dataset_row(sv, "svamp").first()) == ("Body\nQ", "3", "7")


ROUTE = "struct<category:string,intent:array<string>,difficulty:int,budget:int,reasoning_path:array<string>,reasoning_path_options:array<array<string>>>"


def test_growth(spark, tmp_path):
    mk = lambda i, p, ok=True: ((("c", ["i"], 1, 1, [p], None)), ok, i)
    schema = f"route {ROUTE}, gold_matches_answer boolean, _at long"
    for k, rows in enumerate([[mk(0, "a"), mk(1, "a"), mk(2, "b", False)], [mk(3, "b"), mk(4, "d")], [mk(5, "a"), mk(6, "e")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    g = BankGrowth(spark, str(tmp_path / "g"), threshold=3)
    for k in range(3):
        g.batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / f"part={k}")), k)
    assert {tuple(r["reasoning_path"]) for r in g.bank.read().collect()} == {("a",), ("b",), ("d",)}
    assert {tuple(r["reasoning_path"]) for r in g.pending.read().collect()} == {("e",)}
    assert spark.read.parquet(g.history).count() == 1
    g.batch(spark.read.schema(schema).parquet(str(tmp_path / "in" / "part=1")), 1)  # comes again
    assert g.bank.read().count() == 3 and g.pending.read().count() == 1 and spark.read.parquet(g.history).count() == 1


def test_stream_runs_and_resumes(spark, tmp_path):
    schema = f"route {ROUTE}, gold_matches_answer boolean, _at long"
    src = str(tmp_path / "src")
    g = BankGrowth(spark, str(tmp_path / "g"), threshold=1)
    for k, p in enumerate("ab"):
        spark.createDataFrame([(("c", ["i"], 1, 1, [p], None), True, k)], schema).coalesce(1).write.mode("append").parquet(src)
        g.start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "ck")).awaitTermination()
    assert g.bank.read().count() == 2


def test_event_time(spark, tmp_path):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    spark.createDataFrame([("a", t(1), True), ("a", t(1), True), ("b", t(9), False)], "id string, ts timestamp, _ok boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("id string, ts timestamp, _ok boolean").parquet(str(tmp_path / "e"))
    for name, df, mode in (("d1", once_each(s, "id", "ts"), "append"), ("d2", running_accuracy(s), "complete"), ("d3", windowed_counts(s, "ts", "5 minutes", "1 minute"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("d1").count() == 2 and tuple(spark.table("d2").first()) == (2, 3)
    assert spark.table("d3").first()["n"] == 2


def test_stale(spark):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    now = dt.datetime.now(dt.timezone.utc)
    f = spark.createDataFrame([("a", now - dt.timedelta(hours=1)), ("b", now)], "k string, modificationTime timestamp")
    assert {r["k"] for r in stale(cells, f, ["k"]).collect()} == {"a", "c"}


def test_queries_run(spark, data):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_without_training_data_folder(tmp_path):
    """The rest must work if the subpackage is gone."""
    code = "import sys; sys.modules['tracewell.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), any(k.startswith('p1_') for k in e.queries()), 'p4_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["False", "True"]

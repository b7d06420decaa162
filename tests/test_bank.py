"""Bank building, clustering, greedy dedup, routing, growth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import bank as B
from tracewell.operators import cluster, providers, routing
from tracewell.sources import records, sinks

ROUTE = B.ROUTE


def brute_dbscan(x, eps, m):
    n = len(x)
    near = [[j for j in range(n) if np.linalg.norm(x[i] - x[j]) <= eps] for i in range(n)]
    core = [len(a) >= m for a in near]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                if core[i] and core[j] and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    order = {c: k for k, c in enumerate(dict.fromkeys(comp[i] for i in range(n) if core[i]))}
    return [order[comp[i]] if core[i] else min((order[comp[j]] for j in near[i] if core[j]), default=-1) for i in range(n)]


def points(n=120, seed=3):
    rnd = np.random.default_rng(seed)
    return np.vstack([rnd.normal(c, 0.15, (n // 4, 2)) for c in ((0, 0), (1, 1), (2, 0), (0, 3))])


def test_dbscan():
    x = points()
    assert list(cluster.dbscan(x, 0.25, 3)) == brute_dbscan(x, 0.25, 3)


def test_weights_stand_for_repeats():
    x = points(60)
    w = np.random.default_rng(2).integers(1, 4, len(x))
    many = np.repeat(x, w, axis=0)
    first = np.concatenate([[0], np.cumsum(w)[:-1]])
    assert list(cluster.dbscan(x, 0.2, 4, w)) == list(np.array(cluster.dbscan(many, 0.2, 4))[first])
    a, b = cluster.reduce_dims(x, 2, w), cluster.reduce_dims(many, 2)[first]
    assert np.allclose(np.abs(a), np.abs(b))


def test_pca_keeps_distances():
    x = np.random.default_rng(1).normal(size=(6, 3))
    y = cluster.reduce_dims(x)
    assert y.shape == (6, 3)
    assert np.allclose(np.linalg.norm(x[0] - x[1]), np.linalg.norm(y[0] - y[1]))


@pytest.mark.parametrize("dims", [None, 3])
def test_clusters_by_joins(spark, dims, monkeypatch):
    """Groups too large for one task get the clusters that one task would give: dense spots, chains, border points, noise, weights, several blocks."""
    monkeypatch.setattr(cluster, "BLOCK_POINTS", 16)
    rnd = np.random.default_rng(11)
    rows = []
    for g, n in (("a", 150), ("b", 90), (None, 40)):
        spots = rnd.normal(scale=0.7, size=(6, 4))
        for i in range(n):
            x = spots[i % 6] + rnd.normal(scale=0.12, size=4) if i % 5 else np.array([i * 0.02, 0.1, 0.0, 0.0]) if i % 2 else rnd.normal(scale=2, size=4)
            rows.append((g, i, x.tolist(), int(rnd.integers(1, 3))))
    df = spark.createDataFrame(rows, "g string, k int, v array<double>, w int").repartition(4)
    ask = lambda local: {(r["g"], r["k"]): r["cluster"] for r in cluster.cluster_groups(df, group="g", key="k", vec="v", weight="w", eps=0.3, min_samples=4, dims=dims, local=local).collect()}
    want = ask(10_000)
    assert ask(50) == want == ask(0) and len(want) == len(rows) and -1 in want.values() and max(want.values()) >= 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40) if i != 20]
    nodes = spark.createDataFrame([(i,) for i in range(45)], "id long")
    got = {r["id"]: r["label"] for r in cluster.components(nodes, spark.createDataFrame([(b, a) for a, b in chain], "a long, b long")).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 40 else i for i in range(45)}


def test_greedy_dedup(spark):
    rnd = random.Random(4)
    steps = ["StateAnswer", "SetUp", "ListCases", "DrawSketch", "RoundUp"]
    rows = [(c, i, [rnd.choice(steps) for _ in range(rnd.randrange(0, 4))]) for c in "ab" for i in range(25)]
    df = spark.createDataFrame(rows, "c string, pos int, path array<string>").repartition(5)
    got = {(r["c"], r["pos"]): (r["kept"], round(r["score"], 9)) for r in routing.greedy_dedup(df, keys=["c"], path="path", pos="pos", threshold=0.6).collect()}

    def toks(p):
        import re
        return {t.lower() for s in p for t in re.findall("[A-Z]?[a-z]+", s)}

    want = {}
    for c in "ab":
        kept = []
        for _, i, p in [r for r in rows if r[0] == c]:
            best = 0.0
            for q in kept:
                u = toks(p) | toks(q)
                best = max(best, len(toks(p) & toks(q)) / len(u) if u else 0.0)
                if best >= 0.6:
                    break
            want[c, i] = (best < 0.6, round(best, 9))
            if best < 0.6:
                kept.append(p)
    assert got == want
    stats = routing.dedup_stats(routing.greedy_dedup(df, keys=["c"], path="path", pos="pos", threshold=0.6), ["c"]).first()
    assert stats["removed_paths"] == sum(not k for k, _ in want.values())
    # a threshold of 0 removes everything, the first path too
    assert routing.greedy_dedup(df, keys=["c"], path="path", pos="pos", threshold=0.0).where("kept").count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(routing.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


def test_route_ties_and_limit(spark):
    i = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [1.0, 0.0]), (2, "z", [0.0, 1.0])], "pos int, label string, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    got = {r["id"]: r["label"] for r in routing.route_argmax(q, i, q_id="id", q_vec="v", i_pos="pos", i_vec="v", label=["label"]).collect()}
    assert got == {1: "x", 2: "x"}


def test_routing_in_blocks(spark):
    """Several blocks on either side, equal vectors far apart, nulls; no bound on the number of intents."""
    rnd = np.random.default_rng(5)
    n = 2 * routing.BLOCK_ROWS + 50
    v = rnd.normal(size=(n, 6))
    v[n - 1], v[3] = v[7], 0.0
    rows = [(i, "ab"[i % 2], v[i].tolist() if i != 11 else None) for i in range(n)]
    i = spark.createDataFrame(rows, "pos int, label string, v array<double>").repartition(3)
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, n, 40)] + [(7, v[7].tolist()), (9, None)], "id int, v array<double>").repartition(2)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    u[3] = 0.0
    s = np.round(u @ u.T, 12)
    s[:, 11] = -9
    np.fill_diagonal(s, -9)
    got = {r["id"]: (r["pos"], round(r["score"], 9)) for r in routing.route_argmax(q, i.withColumnRenamed("label", "l2"), q_id="id", q_vec="v", i_pos="pos", i_vec="v", label=["l2", "pos"], not_self=True).collect()}
    asked = [*range(0, n, 40), 7]
    assert got == {k: (int(s[k].argmax()), round(float(s[k].max()), 9)) for k in asked} and got[7][0] == n - 1
    top = routing.top_k_paths(q.withColumn("label", F.lit("a")), i.withColumn("p", F.col("pos")), q_id="id", q_vec="v", keys=["label"], path="p", pos="pos", p_vec="v", k=3, not_self=True).collect()
    for k in asked:
        mine = np.where(np.arange(n) % 2 == 0, s[k], -9)
        assert [r["p"] for r in sorted((r for r in top if r["id"] == k), key=lambda r: r["rank"])] == list(np.argsort(-mine, kind="stable")[:3])


def test_route_sources(spark):
    rows = [(1, '{"category": " Cat ", "intent": "one", "reasoning_path": ["a"]}', None), (2, None, '{"route": {"category": "C", "intent": ["x", "y"], "reasoning_path": ["b"]}}'), (3, "no json", None), (4, '{"category": "", "intent": ["i"], "reasoning_path": ["c"]}', None)]
    df = spark.createDataFrame(rows, "id int, route string, response_payload string")
    got = {r["id"]: r["r"] for r in df.select("id", B.route(df).alias("r")).collect()}
    assert got[1]["category"] == "Cat" and got[1]["intent"] == ["one"] and got[2]["intent"] == ["x", "y"] and got[3] is None and got[4]["category"] == "unknown"


def test_base_and_prompt_route(spark):
    df = spark.createDataFrame([(("c", ["i"], 9, 9, None, [["a", "b", "c"], ["a", "b", "c"], ["d"]]),), (("c", ["i"], 1, 1, ["x"], None),)], f"r {ROUTE}")
    b = [r["b"] for r in df.select(B.base_route(F.col("r")).alias("b")).collect()]
    assert (b[0]["reasoning_path"], b[0]["budget"], b[0]["difficulty"]) == (["a", "b", "c"], 3, 2) and (b[1]["budget"], b[1]["difficulty"]) == (1, 1)
    p = [r["p"] for r in df.select(B.prompt_route(F.col("r"), 2).alias("p")).collect()]
    assert p[0]["reasoning_path_options"] == [["a", "b", "c"], ["d"]] and p[0]["reasoning_path"] is None
    ok = df.select(B.path_in_bank(F.array(F.lit("d")), F.col("r")).alias("a"), B.path_source(F.array(F.lit("x")), F.col("r")).alias("s")).collect()
    assert [r["a"] for r in ok] == [True, False] and [r["s"] for r in ok] == ["llm_generated", "reasoning_path_bank"]


def test_merge_and_new(spark):
    bank = spark.createDataFrame([("c", "i", 0, ["a"]), ("c", "i", 1, ["b"])], "category string, intent string, path_pos int, reasoning_path array<string>")
    new = spark.createDataFrame([("c", "i", ["b"], 1), ("c", "i", ["z"], 2), ("c", "i", ["z"], 3), ("d", "j", ["q"], 4)], "category string, intent string, reasoning_path array<string>, o int")
    got = sorted((r["category"], r["path_pos"], r["reasoning_path"]) for r in B.merge_routes(bank, new, "o").collect())
    assert got == [("c", 0, ["a"]), ("c", 1, ["b"]), ("c", 2, ["z"]), ("d", 0, ["q"])]
    assert B.merge_routes(bank, new.limit(0), "o").count() == 2


def test_canonical_names(spark):
    m = spark.createDataFrame([("c", "Find the very long name here", 0), ("c", "Find name", 1), ("c", "Other thing", 2), ("c", "a b c d e", 3)], "category string, intent string, pos int")
    cl = spark.createDataFrame([("c", 0, 0), ("c", 1, 0), ("c", 2, -1), ("c", 3, -1)], "category string, pos int, cluster int")
    got = {r["intent"]: r["canonical"] for r in B.canonical_map(m, cl, "pos").collect()}
    assert got == {"Find the very long name here": "Find name", "Find name": "Find name", "Other thing": "Other thing", "a b c d e": "a b c d"}


def test_build_bank(spark):
    rows = [(i, (cat, intents, 1, 1, path, None), True, None) for i, (cat, intents, path) in enumerate([("c", ["find it", "find it"], ["a"]), ("c", ["find it"], ["a"]), ("c", ["find it"], ["b"]), ("d", ["z", " "], ["q"])])]
    df = spark.createDataFrame(rows + [(9, ("c", ["no"], 1, 1, ["n"], None), False, None)], f"id int, route {ROUTE}, gold_matches_answer boolean, response_payload string")
    r = B.taxonomy_rows(df, "id")
    bank = B.build_bank(r, providers.embedded(r, "intent"))
    got = sorted((x["category"], x["intent"], x["path_pos"], x["reasoning_path"]) for x in bank.collect())
    assert got == [("c", "find it", 0, ["a"]), ("c", "find it", 1, ["b"]), ("d", "z", 0, ["q"])]
    assert tuple(B.summary_global(bank).first()) == (2, 2, 3) and tuple(B.summary_scoped(bank).first()) == (2, 2, 3)


def test_bank_json_round_trip(spark, tmp_path):
    bank = spark.createDataFrame([('c "q"', "i", 0, ["a", "b"]), ('c "q"', "i", 1, ["z"]), ("d", "j\n", 0, [])], "category string, intent string, path_pos int, reasoning_path array<string>")
    sinks.bank_json(bank).coalesce(1).write.text(str(tmp_path / "bank"))
    assert sorted(map(tuple, records.read_bank(spark, str(tmp_path / "bank")).collect())) == sorted(map(tuple, bank.collect()))


def test_vectors_edges(spark):
    """Empty tables, nulls, repeated rows and columns with names of our own give defined results."""
    i = spark.createDataFrame([(0, "x", [1.0, 0.0], 5), (0, "x", [1.0, 0.0], 5), (1, "y", None, 5)], "pos int, label string, v array<double>, score int")
    q = spark.createDataFrame([(1, [2.0, 0.0], "c"), (1, [2.0, 0.0], "c"), (2, None, "c")], "id int, v array<double>, label string")
    ask = lambda q, i: routing.route_argmax(q, i, q_id="id", q_vec="v", i_pos="pos", i_vec="v", label=["label"]).distinct().collect()
    assert [(r["id"], r["label"], r["score"]) for r in ask(q, i)] == [(1, "x", 1.0)]
    assert ask(q.limit(0), i) == [] and ask(q, i.limit(0)) == []
    c = lambda df, local: sorted(tuple(r) for r in cluster.cluster_groups(df, group="label", key="pos", vec="v", eps=0.5, local=local).collect())
    assert c(i, 10) == c(i, 0) == [("x", 0, 0), ("x", 0, 0)]
    assert c(i.limit(0), 10) == c(i.limit(0), 0) == []

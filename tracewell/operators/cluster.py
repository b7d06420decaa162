"""Clustering (M2, M3, M4): PCA and DBSCAN within groups of any size.

A group of at most LOCAL_POINTS distinct points is one task's work. A larger one is clustered by joins: its principal components come from
sums over its parts; its points are laid in a grid of cells as wide as eps, packed into blocks, and blocks of neighbouring cells meet in
one distance matrix each, which gives neighbour counts first and then, for the points with enough of them, a few links; the clusters
are the components of these links, by pointer jumping over written tables. Both ways give the same clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import written

LOCAL_POINTS = 4096
BLOCK_POINTS = 1024
GRID_DIMS = 3
PARTS = 8  # a hot cell's points are packed in so many tasks


def reduce_dims(x: np.ndarray, dims: int = 5, weight: np.ndarray | None = None) -> np.ndarray:
    """M2: principal components, as many as rows, columns and dims allow; signs are free, distances aren't. weight: how often each row counts."""
    w = np.ones(len(x)) if weight is None else weight.astype(float)
    k = min(dims, int(w.sum()), x.shape[1])
    centred = x - np.average(x, axis=0, weights=w)
    _, _, vt = np.linalg.svd(centred * np.sqrt(w)[:, None], full_matrices=False)
    return centred @ vt[:k].T


def dbscan(x: np.ndarray, eps: float, min_samples: int, weight: np.ndarray | None = None) -> np.ndarray:
    """M3: cluster numbers by lowest core index, -1 for noise; a point is its own neighbour; a border point joins the lowest cluster.

    weight: how often each point occurs, so that repeats needn't be rows of their own. Distances are made row by row, so
    memory holds the neighbours only.
    """
    n = len(x)
    w = np.ones(n, dtype=int) if weight is None else weight
    near = [np.flatnonzero(np.sqrt(((x - x[j]) ** 2).sum(-1)) <= eps) for j in range(n)]
    core = np.array([w[a].sum() >= min_samples for a in near], dtype=bool)
    label = np.full(n, -1)
    cluster = 0
    for i in range(n):
        if label[i] != -1 or not core[i]:
            continue
        label[i] = cluster
        todo = [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] == -1:
                    label[j] = cluster
                    if core[j]:
                        todo.append(j)
        cluster += 1
    return label


def cluster_groups(df: DataFrame, *, group: str, key: str, vec: str, weight: str | None = None, eps: float = 0.25, min_samples: int = 2, dims: int | None = 5, local: int = LOCAL_POINTS) -> DataFrame:
    """(group, key, cluster): PCA to `dims` (null: none) and DBSCAN of each group, rows in order of key; a point without a vector is left out.

    Give each distinct point once with its weight: a category's rows may be a third of all, its distinct intents are few.
    """
    n = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    d = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("_group"), F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_vec"), n.alias("_weight"))
    sizes = d.groupBy("_group").agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > local).select("_group")
    out = None
    if large.limit(1).count():
        same = F.col("_group").eqNullSafe(F.col("_g"))
        big = large.withColumnRenamed("_group", "_g")
        out = _by_joins(d.join(big, same, "left_semi"), eps, min_samples, dims)
        d = d.join(big, same, "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable", key=lambda c: c.map(lambda k: tuple(k.values()) if isinstance(k, dict) else k))
        x = np.vstack([np.asarray(v, dtype=float) for v in pdf["_vec"]])
        w = pdf["_weight"].to_numpy()
        return pd.DataFrame({"_group": pdf["_group"], "_key": pdf["_key"], "cluster": dbscan(reduce_dims(x, dims, w) if dims else x, eps, min_samples, w)})

    schema = f"_group {d.schema['_group'].dataType.simpleString()}, _key {d.schema['_key'].dataType.simpleString()}, cluster int"
    small = d.groupBy("_group").applyInPandas(run, schema)
    return (small if out is None else small.unionByName(out)).toDF(group, key, "cluster")


def _reduced(points: DataFrame, dims: int) -> DataFrame:
    """points with _vec projected to the principal components of their group. The sums of a group's parts are a matrix each: they are what is shuffled."""
    kind = points.schema["_group"].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("_group", dropna=False):
                x, w = np.vstack(part["_vec"].to_list()), part["_weight"].to_numpy(float)
                old = held.get(g, (0.0, 0.0, 0.0))
                held[g] = (old[0] + w.sum(), old[1] + w @ x, old[2] + (x * w[:, None]).T @ x)
        yield pd.DataFrame([(g, n, s.tolist(), c.ravel().tolist()) for g, (n, s, c) in held.items()], columns=["_group", "n", "s", "c"])

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].sum(), np.sum(np.vstack(pdf["s"].to_list()), axis=0)
        mean = s / n
        cov = np.sum(np.vstack(pdf["c"].to_list()), axis=0).reshape(len(s), len(s)) - n * np.outer(mean, mean)
        k = min(dims, int(n), len(s))
        v = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
        return pd.DataFrame({"_g": [pdf["_group"].iloc[0]], "_mean": [mean.tolist()], "_axes": [v.T.tolist()]})

    a = points.select("_group", "_vec", "_weight").mapInPandas(sums, f"_group {kind}, n double, s array<double>, c array<double>").groupBy("_group").applyInPandas(axes, f"_g {kind}, _mean array<double>, _axes array<array<double>>")
    centred = F.zip_with("_vec", "_mean", lambda x, m: x - m)
    dot = lambda v: F.aggregate(F.zip_with("_c", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return points.join(a, F.col("_group").eqNullSafe(F.col("_g"))).withColumn("_c", centred).withColumn("_vec", F.transform("_axes", dot)).drop("_g", "_mean", "_axes", "_c")


def _blocks(points: DataFrame, eps: float) -> DataFrame:
    """(_group, _cell, _block, ids, xs, ws, cores): points (_id, _group, _vec, _weight, core) of a cell packed together, at most BLOCK_POINTS in each."""
    kind = points.schema["_group"].dataType.simpleString()
    cell = F.transform(F.slice("_vec", 1, GRID_DIMS), lambda x: F.floor(x / eps).cast("int"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        last = None

        def block() -> pd.DataFrame:
            ids, xs, ws, cores = zip(*rows, strict=True)
            return pd.DataFrame({"_group": [last[0]], "_cell": [list(last[1])], "_block": [ids[0]], "ids": [list(ids)], "xs": [np.concatenate(xs)], "ws": [list(ws)], "cores": [list(cores)]})

        for pdf in batches:
            for g, c, i, x, w, core in zip(*(pdf[k] for k in ("_group", "_cell", "_id", "_vec", "_weight", "core")), strict=True):
                here = (g, tuple(c))
                if rows and (here != last or len(rows) >= BLOCK_POINTS):
                    yield block()
                    rows = []
                last = here
                rows.append((i, x, w, core))
        if rows:
            yield block()

    p = points.withColumn("_cell", cell).select("_group", "_cell", "_id", "_vec", "_weight", "core")
    p = p.repartition("_group", "_cell", F.pmod("_id", F.lit(PARTS))).sortWithinPartitions("_group", "_cell", "_id")
    return p.mapInPandas(lay, f"_group {kind}, _cell array<int>, _block bigint, ids array<bigint>, xs array<double>, ws array<bigint>, cores array<boolean>")


def _meet(blocks: DataFrame, work, schema: str, once: bool) -> DataFrame:
    """work(a, b) -> rows for every two blocks of neighbouring cells of a group (once: each two only once, a block with itself too)."""
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    near = F.array(F.array().cast("array<int>"))

    def beside(so_far: Column, d: int) -> Column:
        """The cells so far, each with the three places of dimension d behind it; a group of fewer dimensions stays."""
        at = F.get("_cell", F.lit(d))
        return F.flatten(F.transform(so_far, lambda c: F.when(F.size("_cell") > d, F.transform(steps, lambda s: F.concat(c, F.array((at + s).cast("int"))))).otherwise(F.array(c))))

    for d in range(GRID_DIMS):
        near = beside(near, d)
    a = blocks.select("_group", F.explode(near).alias("_near"), *[F.col(c).alias("a_" + c) for c in ("_block", "ids", "xs", "ws", "cores")])
    b = blocks.select(F.col("_group").alias("_g"), F.col("_cell").alias("_c"), *[F.col(c).alias("b_" + c) for c in ("_block", "ids", "xs", "ws", "cores")])
    both = a.join(b, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_near") == F.col("_c")) & ((F.col("a__block") <= F.col("b__block")) if once else F.lit(True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                side = lambda s, r=r: (np.array(r[s + "ids"]), np.array(r[s + "xs"]).reshape(len(r[s + "ids"]), -1), np.array(r[s + "ws"]), np.array(r[s + "cores"], dtype=bool))
                yield work(side("a_"), side("b_"))

    return both.select(*[c for c in both.columns if c.startswith(("a_", "b_"))]).mapInPandas(run, schema)


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    return np.vstack([np.sqrt(((b - x) ** 2).sum(-1)) <= eps for x in a])


def _by_joins(points: DataFrame, eps: float, min_samples: int, dims: int | None) -> DataFrame:
    p = _reduced(points, dims) if dims else points
    p = written(p.withColumn("_id", F.monotonically_increasing_id()).withColumn("core", F.lit(False)), "points")

    def degrees(a, b) -> pd.DataFrame:
        return pd.DataFrame({"_id": a[0], "n": _near(a[1], b[1], eps) @ b[2]})

    deg = _meet(_blocks(p, eps), degrees, "_id bigint, n bigint", once=False).groupBy("_id").agg(F.sum("n").alias("n"))
    p = written(p.drop("core").join(deg, "_id").withColumn("core", F.col("n") >= min_samples), "degrees")

    def links(a, b) -> pd.DataFrame:
        """Stars over the local components of core points, and one link of each border point to each of these."""
        (ia, xa, _, ca), (ib, xb, _, cb) = a, b
        near = _near(xa, xb, eps)
        left, right = np.flatnonzero(ca), np.flatnonzero(cb)
        m = near[np.ix_(left, right)]
        out, seen, of_right = [], np.zeros(len(left), dtype=bool), np.full(len(right), -1)
        of_left = np.full(len(left), -1)
        for i in range(len(left)):
            if seen[i] or not m[i].any():
                continue
            todo, root = [i], ia[left[i]]
            seen[i], of_left[i] = True, i
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(m[k] & (of_right < 0)):
                    of_right[j] = i
                    out.append((root, ib[right[j]], False))
                    for n in np.flatnonzero(m[:, j] & ~seen):
                        seen[n], of_left[n] = True, i
                        out.append((root, ia[left[n]], False))
                        todo.append(n)
        for mine, other, grid, ids, other_ids, comp in ((~ca, right, near[:, right], ia, ib, of_right), (~cb, left, near[left].T, ib, ia, of_left)):
            for i in np.flatnonzero(mine):
                at = np.flatnonzero(grid[i])
                if len(at):
                    # cores of one local component need one link; those without a link in this block stand for themselves
                    _, first = np.unique(np.where(comp[at] >= 0, comp[at], -1 - at), return_index=True)
                    out += [(other_ids[other[at[f]]], ids[i], True) for f in first]
        return pd.DataFrame(out, columns=["core", "other", "border"])

    found = written(_meet(_blocks(p, eps), links, "core bigint, other bigint, border boolean", once=True), "links")
    cores = p.where("core").select("_id")
    labels = components(cores.withColumnRenamed("_id", "id"), found.where("not border and core <> other").select(F.col("core").alias("a"), F.col("other").alias("b")))
    keyed = p.where("core").select("_id", "_group", "_key").join(labels.withColumnRenamed("id", "_id"), "_id")
    firsts = keyed.groupBy("_group", "label").agg(F.min("_key").alias("_first"))
    numbers = firsts.withColumn("cluster", (F.row_number().over(Window.partitionBy("_group").orderBy("_first")) - 1).cast("int")).select("label", "cluster")
    of_core = keyed.join(numbers, "label").select("_id", "cluster")
    of_border = found.where("border").join(of_core, F.col("core") == F.col("_id")).groupBy(F.col("other").alias("_id")).agg(F.min("cluster").alias("cluster"))
    every = p.select("_id", "_group", "_key").join(of_core.unionByName(of_border), "_id", "left")
    return every.select("_group", "_key", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the lowest id of each node's component. nodes: id; edges: a, b, either way. Each round takes the lowest label around and then
    jumps to that label's own, so rounds grow with the logarithm of a component's width; each is a written table."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        around = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("_l"))
        lower = labels.join(around, F.col("id") == F.col("_a"), "left").select("id", "label", F.least("label", F.coalesce("_l", F.col("label"))).alias("low"))
        jump = lower.select(F.col("id").alias("_i"), F.col("low").alias("_j"))
        new = written(lower.join(jump, F.col("low") == F.col("_i")).select("id", F.col("_j").alias("label"), (F.col("_j") != F.col("label")).alias("moved")), "labels")
        labels = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            return labels
